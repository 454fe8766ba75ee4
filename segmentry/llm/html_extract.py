"""Main text of web pages by equivalence-class template deduction.

Tokens are element starts, told apart by their path of block elements (with class and id words), and blocks of text, told
apart by path and content. The occurrence vector of a token over the pages of its host is held as a sum of hashes of
(page, count), so it is aggregated like any sum and no host's pages are ever gathered. Tokens of one host with equal
vectors form an equivalence class. A class is valid if it occurs in enough pages and its tokens have distinct mean places
(they are ordered). Valid classes are nested by the paths of their tokens into the host's template; what lies between
template tokens are its slots.

The main slots lie below the article or main elements if these hold at least half of the letters that are
in no link and outside of menus, footers and the like, and otherwise below the lowest element that holds all of these. Of what lies there go:

* elements that are no article text by their tag (menus, footers, asides, forms) or hidden;
* elements with a name such as related, share or alert, but only where they belong to the host's template; on a few pages
  only, they are content (a note, a section on search algorithms) and stay;
* adverts and reader comments by name, wherever they are: they vary and come and go, so no vector tells them;
* template text: blocks with the same words at the same path in nine of ten pages of a host of ``LEAST_PAGES_TEXT`` pages
  or more, if most letters of the page's main slots are not template text.

A page whose host has too few pages, or whose own elements are not in its host's template, is judged by the classes of
the page itself (a vector of length one, so each of its elements belongs to its template).

Blocks: character references are decoded, white space becomes one blank, blocks are joined by two newlines. Edge cases:
null, empty and markup-free pages (the latter: one block of all text); unclosed elements, comments and scripts; repeated
rows and ids; texts of any length; of equally good roots the deeper one counts, then the last by its path; a null URL has
host ""; a column named like an output is replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, spare, texts, with_arrow

LEAST_PAGES = 3
LEAST_SHARE = 0.5
#: Pages of a host, and the share of them with a block of text, that make it template text.
LEAST_PAGES_TEXT, TEXT_SHARE = 10, 0.9
#: The share of such letters that makes an article or main element the root.
LEAST_HELD = 0.5
MOST_BROADCAST = 20_000

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "svg", "select", "object", "canvas", "video", "audio")
NEVER = frozenset((*RAW, "head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label", "option", "datalist"))
#: Words of classes, ids and roles that name something beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay notice "
    "alert widget toolbar pagination pager search skip contentinfo complementary".split())
#: Of these, words for adverts and reader comments, and words that go with them in one name.
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr comment comments disqus reply replies respond".split())
WITH = frozenset("area banner block bottom box container form google item left list middle notice right section slot thread top unit wrapper".split())
#: Elements that end an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
NOT_IN_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

#: Elements that are one block of text.
BLOCKS = frozenset("p li h1 h2 h3 td blockquote pre".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT = "\x01"
TEMPLATE = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("main", "beside", "constant")])

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?P<rawmore>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?P<inner>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|aria-label)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


def _named(name: str, more: str) -> tuple[str, bool, bool]:
    """The element with the words that tell it apart, whether it is no article text by itself, and whether its name says so."""
    if not more or more == "/":
        return name, name in NEVER, False
    words: list[str] = []
    hidden = always = False
    for key, value in ATTRIBUTE.findall(more):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            for token in value.split():
                parts = re.findall(r"[a-z]+", token)
                words += parts
                always = always or not ALWAYS.isdisjoint(parts) and ALWAYS.union(WITH).issuperset(parts)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    frame = name in ("html", "body", "main") or name == "article" and not always
    return name + "".join("." + w for w in words) + ("!" if hidden else ""), name in NEVER or hidden or (always and not frame), not frame and not BESIDE.isdisjoint(words)


def walk(page: str) -> Iterator[tuple[str, str, object]]:
    """("start", path, (no article text by itself, named so)) for each block element and ("text", path, (text, letters in
    links, no article text, paths of the elements around it that are named so)) for each block of text."""
    stack: list[tuple[str, str, bool, str]] = []  # name, shown, no article text, own path if named so
    path, never, named = "", False, ()
    text: list[str] = []
    links, in_link, linked = 0, False, 0
    at = 0

    def flush():
        nonlocal text, links
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text, held = [], links
            links = 0
            if whole:
                return [("text", path, (whole, held, never, named))]
        return []

    def drop(to: int):
        nonlocal path, never, named
        del stack[to:]
        path = "/".join(s[1] for s in stack)
        never = any(s[2] for s in stack)
        named = tuple(s[3] for s in stack if s[3])

    for tag in TAG.finditer(page):
        if tag.start() > at:
            piece = page[at : tag.start()]
            text.append(piece)
            links += len(piece) if in_link else 0
        at = tag.end()
        name = tag["name"]
        if tag["raw"]:
            text.append(" ")
            continue
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not tag["end"]
            continue
        if name in VOID:
            if name == "hr":
                yield from flush()
            else:
                text.append(" ")
            continue
        yield from flush()
        if tag["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    drop(i)
                    break
            continue
        if name in NOT_IN_P or name in CLOSES:
            closes = CLOSES.get(name, set()) | ({"p"} if name in NOT_IN_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    drop(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "dl", "div", "article", "section", "body", "main", "nav", "blockquote"):
                    break
        shown, own, by_name = _named(name, tag["more"] or "")
        if name == "header" and not any(s[0] in ("article", "main") for s in stack):
            own = True
        path = f"{path}/{shown}" if path else shown
        stack.append((name, shown, own, path if by_name else ""))
        never = never or own
        if by_name:
            named = (*named, path)
        in_link = False
        yield ("start", path, (own, by_name))
    if at < len(page):
        text.append(page[at:])
    yield from flush()


def text_token(path: str, text: str) -> str:
    """A block of text as a token; its path is told by the element tokens."""
    return TEXT + hashlib.blake2b(f"{path}{TEXT}{text}".encode("utf-8", "replace"), digest_size=8).hexdigest()


def occurrences(page: str) -> dict[str, list[float]]:
    """Token: [count, place of the first, letters of text outside of links (directly below an element), no article text,
    named so]."""
    found: dict[str, list[float]] = {}
    for place, (kind, path, what) in enumerate(walk(page)):
        if kind == "start":
            if path in found:
                found[path][0] += 1
            else:
                found[path] = [1, place, 0, float(what[0]), float(what[1])]
        elif path in found:
            letters = max(0, len(what[0]) - what[1])
            found[path][2] += letters
            token = text_token(path, what[0])
            if token in found:
                found[token][0] += 1
            else:
                found[token] = [1, place, letters, 0.0, 0.0]
    return found


def _sums(host_url_html):
    """Partial sums for each host and token: vector hash, pages, occurrences, places, letters, flags."""
    for batch in host_url_html:
        if not batch.num_rows:
            continue
        sums: dict[tuple[str, str], list] = {}
        for host, url, page in zip(*(texts(batch.column(i)) for i in range(3))):
            mark = hashlib.blake2b(page.encode("utf-8", "replace") + url.encode("utf-8", "replace"), digest_size=8).digest()
            total = sums.setdefault((host, ""), [0, 0, 0, 0.0, 0, 0])
            total[1] += 1
            for token, (count, place, letters, never, named) in occurrences(page).items():
                value = int.from_bytes(hashlib.blake2b(mark + int(count).to_bytes(4, "big"), digest_size=7).digest(), "big") >> 16
                s = sums.setdefault((host, token), [0, 0, 0, 0.0, 0, 0])
                s[0] += value
                s[1] += 1
                s[2] += int(count)
                s[3] += place
                s[4] += int(letters)
                s[5] = int(never) | int(named) << 1
        columns = [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums])]
        columns += [pa.array([v[i] for v in sums.values()], type=pa.float64() if i == 3 else pa.int64()) for i in range(6)]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "token", "vector", "pages", "total", "places", "letters", "flags"])


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".")[0].rstrip("!")


def _below(path: str, roots) -> bool:
    return any(path == r or path.startswith(r + "/") for r in roots)


def template(rows: list[tuple[str, tuple, float, float, int, int]], pages: int) -> dict[str, list[str]]:
    """A host's template: main (paths of the roots of its main slots), beside (named elements of the template) and
    constant (tokens of template text).

    ``rows``: (token, vector, share of pages, mean place, letters, flags: 1 no article text, 2 named so) of one host.
    """
    classes: dict[tuple, list[tuple]] = {}
    for row in rows:
        classes.setdefault(row[1], []).append(row)
    valid = [c for c in classes.values() if len({r[3] for r in c}) == len(c) and c[0][2] >= LEAST_SHARE]
    tokens = {r[0]: r for c in valid for r in c}
    elements = {t: r for t, r in tokens.items() if not t.startswith(TEXT)}
    constant = sorted(r[0] for r in rows if r[0].startswith(TEXT) and pages >= LEAST_PAGES_TEXT and r[2] >= TEXT_SHARE)
    beside = sorted(t for t, r in elements.items() if r[5] & 2)
    out = {"main": [], "beside": beside, "constant": constant}
    outside = {t for t, r in elements.items() if r[5]}
    inside = {t: r for t, r in elements.items() if not _below(t, outside)}
    total = sum(r[4] for r in inside.values())
    # letters of each element with all that it holds
    held = {t: sum(r[4] for u, r in inside.items() if _below(u, (t,))) for t in inside}
    frame = {r[0] for r in max(valid, key=lambda c: (c[0][2], len(c)))} if valid else set()
    for wanted in ("article", "main"):
        best = sorted((t for t in inside if _name(t) == wanted), key=lambda t: (t not in frame, t.count("/"), t))
        best = [t for t in best if not any(t.startswith(o + "/") for o in best)]
        if best and sum(held[t] for t in best) >= LEAST_HELD * total:
            return out | {"main": best}
    if total:
        # the deepest element that holds all of it and holds blocks rather than being one
        roots = [t for t, n in held.items() if n >= total and _name(t) not in BLOCKS]
        out["main"] = [max(roots, key=lambda t: (t.count("/"), t))] if roots else []
    return out


def templates(pages: DataFrame, host: str, url: str = "url", page: str = "html") -> DataFrame:
    """(host, template) of each host with enough pages."""
    shape = "host string, token string, vector long, pages long, total long, places double, letters long, flags long"
    by_token = pages.select(F.col(host), F.col(url), F.col(page)).mapInArrow(_sums, shape).groupBy("host", "token").agg(
        F.sum(F.col("vector").cast("decimal(38,0)")).cast("string").alias("vector"), F.sum("pages").alias("pages"), F.sum("total").alias("total"),
        F.sum("places").alias("places"), F.sum("letters").alias("letters"), F.max("flags").alias("flags"))
    by_token = durable(by_token.where("token = '' or pages > 1"))
    counts = by_token.where("token = ''").select("host", F.col("pages").alias("of")).where(f"of >= {LEAST_PAGES}")
    # at most 1 / LEAST_SHARE times the mean number of tokens of a page reach the share: bounded for each host
    often = by_token.where("token <> ''").join(counts, "host").where(f"pages >= {LEAST_SHARE} * of")
    gathered = often.groupBy("host", "of").agg(F.collect_list(F.struct("token", "vector", "pages", "total", "places", "letters", "flags")).alias("tokens"))

    def start():
        def run(of, tokens):
            out = []
            for n, rows in zip(of.to_pylist(), tokens.to_pylist()):
                out.append(template([(r["token"], (r["vector"], r["pages"], r["total"]), r["pages"] / n, r["places"] / r["pages"], r["letters"], r["flags"]) for r in rows], n))
            return [out]

        return run

    return durable(with_arrow(gathered, ["of", "tokens"], [T.StructField("template", TEMPLATE)], start, keep=["host"]))


def own_template(page: str) -> dict[str, list[str]]:
    return template([(t, (c,), 1.0, place, int(letters), int(never) | int(named) << 1) for t, (c, place, letters, never, named) in occurrences(page).items()], 1)


def main_text(page: str, of_host: dict[str, list[str]] | None) -> str:
    """The blocks in the main slots; if the page has none of them, its own classes decide."""
    if not page:
        return ""
    blocks = [(path, what) for kind, path, what in walk(page) if kind == "text"]
    known = of_host
    if not known or not any(_below(path, known["main"]) for path, _ in blocks):
        known = own_template(page)
        if not any(path for path, _ in blocks):
            return "\n\n".join(what[0] for _, what in blocks)
    roots, beside, constant = known["main"], frozenset(known["beside"]), frozenset(known["constant"])
    root_of = lambda named: any(n in beside and _below(n, roots) and n not in roots for n in named)
    kept = [(path, what) for path, what in blocks if _below(path, roots) and not what[2] and not root_of(what[3])]
    if constant:
        varying = [what for path, what in kept if text_token(path, what[0]) not in constant]
        if 2 * sum(len(w[0]) for w in varying) > sum(len(w[0]) for _, w in kept):
            return "\n\n".join(w[0] for w in varying)
    return "\n\n".join(what[0] for _, what in kept)


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each whole page."""
    host, known = spare(pages, "_host", "_template")
    placed = pages.drop(out).withColumn(host, F.coalesce(F.translate(F.regexp_extract(F.col(url), r"^[^:/?#]*://([^/?#]*)", 1), UPPER, LOWER), F.lit("")))
    hosts = templates(placed, host, url, page).select(F.col("host").alias(host), F.col("template").alias(known))
    few = hosts.count() <= MOST_BROADCAST
    joined = placed.join(F.broadcast(hosts) if few else hosts, host, "left")
    done = with_arrow(joined, [page, known], [T.StructField(out, T.StringType())], lambda: lambda p, m: [[main_text(a, b) for a, b in zip(texts(p), m.to_pylist())]])
    return done.drop(host, known)
