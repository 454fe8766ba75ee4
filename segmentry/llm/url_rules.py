"""URL filtering by given host rules, and by association rules where no given rule fits.

Association rules: the distinct tokens of each labelled URL and its label are one transaction. Spark's FP-growth finds
the frequent sets; rules tokens -> label with enough support and confidence stay, without those that a rule of fewer
tokens, the same label and no less confidence already covers. Confidence is balanced: what it would be if both labels, or
all others together, were equally frequent; so a rule must tell something about a label, however rare that label is. Matching is by inverted index: a rule is posted under its
rarest token only, and a URL looks at the postings of its own tokens. Of several matches the most confident wins, then
the one of most support, then the first by its text. Where none matches, the verdict is ``allow``.

Before mining, tokens of too little support go, tokens that occur in the same labelled URLs are one (the longest name
stands for all in a rule's text, and a and a URL with any of them has it), and tokens of all labelled URLs go: they could only repeat rules. of all labelled URLs go: they could only repeat rules. The support of a rule is a share of the
labelled URLs and at least ``LEAST_ROWS`` of them, so few labels give few rules. The tokens sent to the tasks number at
most the tokens of a URL / ``SUPPORT``. Rules are pruned as they
come from the tasks, the shortest first; none is dropped for their number.

Edge cases: a null URL or one without "://" has empty host and path, no given rule and no tokens but its form, so it is
allowed; repeated rows are judged alike; without labels there are no association rules; labels null on both sides are
ignored; a column named like an output is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare, texts, with_arrow

SUPPORT = 0.005
LEAST_ROWS = 20
CONFIDENCE = 0.8
LABEL = "\u0000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: str) -> set[str]:
    """What URLs are compared by: scheme, host and its parents, path segments by place, numbers' lengths, extension, query keys."""
    scheme, found, rest = url.partition("://")
    if not found:
        return {"form=none"}
    host = re.match(r"[^/?#]*", rest)[0].lower()
    path, _, query = rest[len(host) :].partition("#")[0].partition("?")
    labels = host.rsplit(":", 1)[0].split(".")
    out = {f"scheme={scheme.lower()}", f"depth={path.count('/')}"}
    out |= {"host=" + ".".join(labels[i:]) for i in range(len(labels)) if labels[i]}
    if len(labels) > 2:
        out.add(f"first={labels[0]}")
    segments = [s for s in path.split("/") if s]
    for i, segment in enumerate(segments):
        name, dot, extension = segment.rpartition(".")
        out.add(f"path{i}={re.sub('[0-9]+', '0', segment.lower())}")
        if dot and name:
            out.add(f"ext={extension.lower()}")
    out |= {f"query={p.partition('=')[0].lower()}" for p in query.split("&") if p}
    if "#" in rest:
        out.add("fragment")
    return out


@dataclass(frozen=True)
class Mined:
    tokens: frozenset
    label: str
    confidence: float
    support: float
    #: For each token in order, all tokens that occur in the same labelled URLs; any of them will do.
    same: tuple[tuple[str, ...], ...] = ()

    def fits(self, own: set[str]) -> bool:
        return all(not own.isdisjoint(members) for members in self.same) if self.same else self.tokens <= own

    @property
    def text(self) -> str:
        return " & ".join(sorted(self.tokens)) + " -> " + self.label


def _representatives(items: DataFrame, rows: int, least: float) -> dict[str, tuple[str, ...]]:
    """Of the tokens in ``least`` rows or more, but not in all, one for each set of rows they occur in: all tokens of it."""
    counted = (
        items.select("_k", F.explode("items").alias("token"))
        .groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("_k").cast("decimal(20,0)")).alias("where"))
        .where((F.col("n") >= least) & (F.col("n") < rows))
    )
    # rows of equal URLs share a key and all tokens, so the sum of keys stands for the rows
    one = counted.groupBy("n", "where").agg(F.max(F.struct(F.length("token").alias("size"), "token")).alias("longest"), F.sort_array(F.collect_list("token")).alias("members"))
    return {r[0]: tuple(r[1]) for r in one.select("longest.token", "members").collect()}


def _pruned_rules(baskets: DataFrame, rows: int, support: float, confidence: float, classes: dict[str, tuple[str, ...]]) -> list[Mined]:
    """Rules tokens -> label that no rule of fewer tokens covers. They come by size, so only those that stay are held."""
    shares = {r[0][1:]: r[1] for r in baskets.select(F.element_at("items", -1).alias("l")).groupBy("l").agg(F.count("*") / F.lit(float(rows))).collect()}
    if len(shares) < 2:
        least = {label: confidence for label in shares}  # nothing to tell apart
    else:
        # the plain confidence at which the balanced one reaches the bound
        least = {label: confidence * p / (confidence * p + (1 - confidence) * (1 - p)) for label, p in shares.items()}
    if not least:
        return []
    model = FPGrowth(minSupport=support, minConfidence=min(least.values()), itemsCol="items").fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL) & ~F.exists("antecedent", lambda t: t.startswith(LABEL)))
    label = F.substring(F.element_at("consequent", 1), 2, 1 << 20)
    bound, plain = (F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("label")] for d in (least, shares))
    odds = F.col("confidence") * (1 - plain) / ((1 - F.col("confidence")) * plain)
    balanced = F.when(F.col("confidence") >= 1, 1.0).otherwise(odds / (1 + odds)) if len(shares) > 1 else F.col("confidence")
    rows_of = found.select("antecedent", label.alias("label"), "confidence", "support").where(F.col("confidence") >= bound - 1e-9)
    rows_of = rows_of.withColumn("confidence", F.round(balanced, 9)).orderBy(F.size("antecedent"))
    kept: list[Mined] = []
    by_token: dict[str, list[Mined]] = {}
    for r in rows_of.toLocalIterator():
        rule = Mined(frozenset(r["antecedent"]), r["label"], r["confidence"], r["support"], tuple(classes[t] for t in sorted(r["antecedent"])))
        if not any(k.label == rule.label and k.confidence >= rule.confidence and k.tokens <= rule.tokens for t in rule.tokens for k in by_token.get(t, ())):
            kept.append(rule)
            by_token.setdefault(min(rule.tokens), []).append(rule)
    return sorted(kept, key=lambda k: (len(k.tokens), -k.confidence, k.text))


def mine(urls: DataFrame, url: str = "url", label: str = "label", support: float = SUPPORT, confidence: float = CONFIDENCE, least_rows: int = LEAST_ROWS) -> list[Mined]:
    """Pruned rules from labelled URLs."""
    labelled = urls.where(F.col(label).isNotNull()).select(F.col(url).alias("_u"), F.xxhash64(url).alias("_k"), F.col(label).cast("string").alias("_l"))
    made = with_arrow(labelled, ["_u"], [T.StructField("items", T.ArrayType(T.StringType()))], lambda: lambda c: [[sorted(tokens(u)) for u in texts(c)]], keep=["_k", "_l"]).persist()
    try:
        rows = made.count()
        support = max(support, least_rows / max(1, rows))
        names = _representatives(made, rows, support * rows) if support <= 1 else {}
        if not names:
            return []
        made_of = with_arrow(made, ["items"], [T.StructField("items", T.ArrayType(T.StringType()))], lambda: lambda c: [[[t for t in x if t in names] for x in c.to_pylist()]], keep=["_l"])
        baskets = made_of.select(F.array_append("items", F.concat(F.lit(LABEL), "_l")).alias("items")).persist()
        try:
            return _pruned_rules(baskets, rows, support, confidence, names)
        finally:
            baskets.unpersist()
    finally:
        made.unpersist()


class Index:
    """Rules posted under their rarest token."""

    def __init__(self, rules: list[Mined]):
        often = Counter(t for r in rules for t in r.tokens)
        self.postings: dict[str, list[Mined]] = {}
        for rule in sorted(rules, key=lambda r: (-r.confidence, -r.support, r.text)):
            rarest = min(rule.tokens, key=lambda t: (often[t], t))
            for token in rule.same[sorted(rule.tokens).index(rarest)] if rule.same else (rarest,):
                self.postings.setdefault(token, []).append(rule)

    def match(self, url: str) -> Mined | None:
        own, best = tokens(url), None
        for token in own:
            for rule in self.postings.get(token, ()):
                if rule.fits(own):
                    if best is None or (-rule.confidence, -rule.support, rule.text) < (-best.confidence, -best.support, best.text):
                        best = rule
                    break
        return best


def judge(urls: DataFrame, mined: list[Mined], rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict, mined_rule and mined_confidence."""
    made = ("host", "path", "rule", "verdict", "mined_rule", "mined_confidence")
    others = [c for c in urls.columns if c not in made or c == url]
    host, path = parts(F.col(url))
    of_host, of_path, of_rule, of_verdict, of_mined = spare(urls, "_host", "_path", "_rule", "_verdict", "_mined")
    placed = urls.select(*[F.col(f"`{c}`") for c in others], host.alias(of_host), path.alias(of_path))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(of_host) == h) | F.col(of_host).endswith("." + h)) & F.col(of_path).startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)

    def start():
        index = Index(mined)

        def run(column):
            found = [index.match(u) for u in texts(column)]
            return [[r and r.text for r in found], [r and r.confidence for r in found], [r and r.label for r in found]]

        return run

    fields = [T.StructField("mined_rule", T.StringType()), T.StructField("mined_confidence", T.DoubleType()), T.StructField(of_mined, T.StringType())]
    judged = with_arrow(placed.withColumns({of_rule: rule, of_verdict: verdict}), [url], fields, start)
    return judged.select(
        *[F.col(f"`{c}`") for c in others], F.col(of_host).alias("host"), F.col(of_path).alias("path"), F.col(of_rule).alias("rule"),
        F.coalesce(of_verdict, of_mined, F.lit("allow")).alias("verdict"), "mined_rule", "mined_confidence")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Training URLs: pages whose document is labelled; block if it is of low quality or toxic."""
    of = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    label = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), "allow")
    return pages.select("page_id", "url").join(of, "page_id").select("url", label.alias("label"))
