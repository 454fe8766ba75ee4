"""Mixing by iterative proportional fitting, in DataFrame functions only.

Token masses of the cells source x language x topic are raked until the expected sample meets the target share of every
source, language and topic; each document is then kept with its cell's probability. A cell's probability is
min(1, a[source] * b[language] * c[topic]). For given b and c, each source's a follows from the source's own cells, so a
sweep is one pass over one row for each source; only the sums by language and topic come to the driver. Their number is
bounded: topics are the rules below, and languages are counted first (more than ``MOST_PAIRS`` pairs is an error).

Targets: shares given by the caller, or the tempered shares (mass ** ``temper``, normalised), which raise small sources.
No target asks for more tokens than there are; languages and topics share the sources' total.

Edge cases: null source or language is a value of its own (shown as null); texts that are null or have no words have
topic "empty", mass 0 and probability 1 (they cost nothing); rows with equal ids share their fate; a column named like an
output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, spare

SHARE = 0.5
TEMPER = 0.7
SWEEPS = 40
CLOSE = 1e-4
MOST_PAIRS = 100_000
#: Up to so many sources (some 100 bytes each) their factors are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000
NULL = "\u0000"


def topic(text: Column, tokens: Column) -> Column:
    """A coarse kind of text by rules on its characters."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return (
        F.when(tokens == 0, "empty")
        .when(count(r"\|") * 4 > tokens, "table")
        .when(count(r"[#$%&*]{3}") * 3 > tokens, "symbols")
        .when(count("!!") * 3 > tokens, "shouted")
        .when(tokens < 100, "short")
        .when(tokens < 1000, "medium")
        .otherwise("long")
    )


def cells_of(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """Add _s, _l (null made a value), topic and n_tokens (words)."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long")
    keyed = docs.withColumn("n_tokens", words).withColumn("_s", F.coalesce(F.col(source).cast("string"), F.lit(NULL)))
    return keyed.withColumn("_l", F.coalesce(F.col(lang).cast("string"), F.lit(NULL))).withColumn("topic", topic(F.coalesce(F.col(text), F.lit("")), F.col("n_tokens")))


def _targets(masses: dict[str, float], temper: float, given: dict[str, float] | None, total: float) -> dict[str, float]:
    """Token targets that add up to ``total`` where they can: what exceeds a value's mass goes to the others in proportion."""
    raw = {k: given.get(k, 0.0) if given else m**temper for k, m in masses.items()}
    full: dict[str, float] = {}
    while True:
        rest = sum(v for k, v in raw.items() if k not in full)
        scale = max(0.0, total - sum(full.values())) / rest if rest > 0 else 0.0
        more = {k: masses[k] for k, v in raw.items() if k not in full and v * scale > masses[k]}
        if not more:
            return {k: full.get(k, v * scale) for k, v in raw.items()}
        full |= more


def _source_factor(entries: Column, factors: Column, target: Column) -> Column:
    """a with sum(mass * min(1, a * factor)) = target, by repeated scaling."""
    mass = lambda a: F.aggregate(entries, F.lit(0.0), lambda t, e: t + e["mass"] * F.least(F.lit(1.0), a * F.get(factors, e["pair"])))
    loose = F.aggregate(entries, F.lit(0.0), lambda t, e: t + e["mass"] * F.get(factors, e["pair"]))
    first = F.when(loose > 0, target / loose).otherwise(F.lit(0.0))
    return F.aggregate(F.array(*[F.lit(i) for i in range(12)]), first, lambda a, _: F.transform(F.array(mass(a)), lambda m: F.when(m > 0, a * target / m).otherwise(a))[0])


def fit(cells: DataFrame, share: float = SHARE, temper: float = TEMPER, sources: dict[str, float] | None = None,
        langs: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> tuple[DataFrame, dict[tuple[str, str], float], int]:
    """Factors of the sources as a DataFrame (_s, a), factors of (language, topic) pairs, and how many sources there are.

    ``sources``, ``langs`` and ``topics`` are target shares by value; a value that is not named gets none.
    """
    sums = durable(cells.where("n_tokens > 0").groupBy("_s", "_l", "topic").agg(F.sum("n_tokens").cast("double").alias("mass")))
    by_pair = sums.groupBy("_l", "topic").agg(F.sum("mass").alias("mass"))
    rows = by_pair.limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of language and topic")
    pairs = sorted((r["_l"], r["topic"]) for r in rows)
    masses = {(r["_l"], r["topic"]): r["mass"] for r in rows}
    total = sum(masses.values())
    margin = lambda i: {k: sum(m for p, m in masses.items() if p[i] == k) for k in sorted({p[i] for p in pairs})}
    number = F.create_map(*[x for i, (a, b) in enumerate(pairs) for x in (F.concat(F.lit(a), F.lit("\u0001"), F.lit(b)), F.lit(i))]) if pairs else F.lit(None)
    pair = F.element_at(number, F.concat("_l", F.lit("\u0001"), "topic")) if pairs else F.lit(0)
    by_source = sums.groupBy("_s").agg(F.collect_list(F.struct(pair.alias("pair"), F.col("mass"))).alias("entries"), F.sum("mass").alias("mass"))
    raw = F.coalesce(F.element_at(F.create_map(*[x for k, v in sources.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("_s")), F.lit(0.0)) if sources else F.pow("mass", F.lit(temper))
    by_source = by_source.withColumn("raw", raw)
    n, whole = by_source.agg(F.count("*"), F.sum("raw")).first()
    target = F.least(F.col("mass"), F.col("raw") / F.lit(whole or 1.0) * F.lit(share * total))
    table = durable(by_source.select("_s", "entries", target.alias("target")).coalesce(max(1, n // 50_000)))
    goal = table.agg(F.sum("target")).first()[0] or 0.0
    wanted = [_targets(margin(i), temper, given, goal) for i, given in ((0, langs), (1, topics))]
    factors = [{k: 1.0 for k in w} for w in wanted]
    flat = lambda: [factors[0][a] * factors[1][b] for a, b in pairs]
    with_a = lambda: table.withColumn("a", _source_factor(F.col("entries"), F.array(*[F.lit(x) for x in flat()]), F.col("target")))
    for _ in range(SWEEPS if pairs else 0):
        change = 0.0
        now = flat()
        spread = with_a().select(F.explode("entries").alias("e"), "a", F.array(*[F.lit(x) for x in now]).alias("f"))
        taken = spread.groupBy(F.col("e.pair").alias("pair")).agg(F.sum(F.col("e.mass") * F.least(F.lit(1.0), F.col("a") * F.get("f", F.col("e.pair")))).alias("m"))
        got = {pairs[r["pair"]]: r["m"] for r in taken.collect()}
        for i, want in enumerate(wanted):
            scale = {}
            for k, t in want.items():
                m = sum(v for p, v in got.items() if p[i] == k)
                scale[k] = t / m if m > 0 else 1.0
                factors[i][k] *= scale[k]
                change = max(change, abs(scale[k] - 1))
            got = {p: v * scale[p[i]] for p, v in got.items()}
        if change < CLOSE:
            break
    return (with_a().select("_s", "a") if pairs else table.select("_s", F.lit(1.0).alias("a"))), dict(zip(pairs, flat())), n


def mix(docs: DataFrame, share: float = SHARE, temper: float = TEMPER, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source",
        lang: str = "lang", sources: dict[str, float] | None = None, langs: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> DataFrame:
    """All rows with topic, n_tokens, weight (sampling weight, 1 / prob), prob and sampled."""
    made = ("topic", "n_tokens", "weight", "prob", "sampled")
    # the caller's columns step aside for those that the work adds
    clash = [c for c in docs.columns if c.lower() in ("_s", "_l", "a") and c not in made]
    aside = dict(zip(clash, spare(docs, *[f"_own_{c}" for c in clash])))
    key, text, source, lang = (aside.get(c, c) for c in (key, text, source, lang))
    cells = cells_of(docs.drop(*[c for c in made if c in docs.columns]).withColumnsRenamed(aside), text, source, lang)
    table, pairs, n = fit(cells, share, temper, sources, langs, topics)
    factor = F.element_at(F.create_map(*[x for (a, b), v in pairs.items() for x in (F.concat(F.lit(a), F.lit("\u0001"), F.lit(b)), F.lit(v))]), F.concat("_l", F.lit("\u0001"), "topic")) if pairs else F.lit(1.0)
    joined = cells.join(F.broadcast(table) if n <= MOST_BROADCAST else table, "_s", "left")
    prob = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("a"), F.lit(0.0)) * F.coalesce(factor, F.lit(0.0))))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = joined.withColumn("prob", prob).withColumn("weight", F.when(F.col("prob") > 0, 1 / F.col("prob"))).withColumn("sampled", place < F.col("prob"))
    return drawn.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns if c not in made], *made)
