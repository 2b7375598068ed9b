"""Main text of web pages by wrappers inferred per host.

A page's token stream is folded into a union-free regular expression over its elements: text becomes a slot, and
neighbouring elements or runs of up to three elements that repeat become one repeated group (very many siblings without
such an order become one group in which each is optional).  The expressions of a host are aligned one after the other; parts that only one side has become optional, counts that differ become
repeats, until one wrapper describes every page of the host.  Slots carry the elements they stand in and, over all
pages of the host, how much text they held.  A page's main text is all of its text that does not stand in boilerplate:
titles, leads and what follows stay beside an article or the container that holds most.  Of it the template's text goes:
what outside article and main elements is the same in one slot of every page of the host that has the slot, unless it
stands on the page in a container beside text that varies: headings, table heads and labels stay.

All pages take part in the wrapper of their host.  Equal expressions are counted before they are aligned, and a host
with many different ones is aligned in rounds of bounded groups, so neither a large host nor an irregular one ends up
in one task.
"""

from __future__ import annotations

import difflib
import functools
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import col, durable, text_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                   r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements of HTML; all others are one to expressions, as are names that propose nothing: pages make up as many as they like.
KNOWN = frozenset("a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas caption center "
                  "cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font "
                  "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link "
                  "main map mark menu meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp "
                  "rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table "
                  "tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr xmp".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr br img".split())
# Elements of text: blocks, lists and tables.  What holds them is a container.
TEXTUAL = frozenset("address blockquote caption center col colgroup dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre summary "
                    "table tbody td tfoot th thead tr ul".split())
# An element that opens closes these, when one is open and no element of the second list stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                    "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# What is never main text, by element, and the words of class, id or role tokens that propose boilerplate.
BOILER_TAGS = frozenset("head nav footer aside form script style noscript template svg button select textarea input iframe menu dialog "
                        "object embed audio video canvas map".split())
BOILER_WORDS = frozenset("nav navbar navigation menu menubar header masthead footer sidebar aside ad ads adv advert adverts advertisement "
                         "advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert "
                         "popup modal overlay newsletter subscribe signup login search share sharing social comment comments reply replies "
                         "disqus respond discussion related recommended recommendations breadcrumb breadcrumbs pagination pager widget "
                         "toolbar skip contentinfo complementary form disclaimer copyright tags meta byline".split())
BOILER_BEGINNINGS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor")
# Words that do not change what a token says, words of content that may precede what it names ('post-tags'), and words
# that are headings' slugs as often as names when they stand in an id.
FILL_WORDS = frozenset("area bar block bottom box button buttons container element global group icon icons inner item items left link links "
                       "list main module outer panel primary region right secondary section site slot top unit wrap wrapper".split())
OWNER_WORDS = frozenset("article entry page post story".split())
OWN_WORDS = frozenset("banner form header masthead notice notices".split())      # of an article: 'post-header' holds its title
SLUG_WORDS = frozenset("advertising alert consent copyright disclaimer discussion form meta notice notices notification promotion "
                       "recommendations recommended related reply search sharing skip social tags".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CARD_WORDS = frozenset("ad advert advertisement comment comments promo related reply sponsored teaser widget".split())
GROUP = 32              # expressions aligned in one group
DEEP = 100              # levels beyond which an element only ends the block before it
MANY = 150              # folded siblings beyond which their order is given up: (a* b* c*)+
SEVERAL = 5             # different pages of a host that must have a slot before its text counts as the template's


@functools.lru_cache(100_000)
def proposal(token: str) -> tuple[str, bool]:
    """The boilerplate word that a whole token of a class, id or role stands for, empty for none, and whether it is one
    word.  Every word must have its part in it: 'ad-slot' and 'post-tags' do, 'has-sidebar' and 'social-impact' not."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if w]
    named = [w for w in words if w in BOILER_WORDS or w.startswith(BOILER_BEGINNINGS)]
    rest = [w for w in words if w not in named and w not in FILL_WORDS]
    if not named or rest and (words[0] not in OWNER_WORDS or len(rest) > 1 or words[-1] not in named or OWN_WORDS & set(named)):
        return "", False
    return next((w for w in BOILER_BEGINNINGS if named[0].startswith(w) and named[0] not in BOILER_WORDS), named[0]), len(words) == 1


def signature(tag: str, attrs: str) -> str:
    """An element's name in the expression: tag, "hidden", and, after a "~", the listed words by which whole tokens of its
    class, id and role propose that it is boilerplate.  No page adds names of its own."""
    if not attrs or attrs.isspace():
        return tag if tag in KNOWN else "x"
    words = set()
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            words.add("hidden")
        elif name in ("class", "id", "role"):
            for token in value.split():
                if name != "id" and token.lower() == "hidden":
                    words.add("hidden")
                word, single = proposal(token)
                if not word or tag in ("html", "body", "main") or tag == "article" and word not in CARD_WORDS:
                    continue
                if name != "id" or tag not in HEADINGS and not (single and word in SLUG_WORDS):
                    words.add("~" + word)
    return ".".join([tag if tag in KNOWN else "x", *sorted(words)])


def never(sig: str, inside_article: bool) -> bool:
    """Whether an element with this signature never holds main text."""
    tag, *words = sig.split(".")
    return tag in BOILER_TAGS or "hidden" in words or tag == "header" and not inside_article


def proposed(sig: str) -> bool:
    """Whether the names of an element propose that it is boilerplate; host and page can show that it is not."""
    return ".~" in sig


def boiler(sig: str, inside_article: bool) -> bool:
    """Whether an element with this signature is boilerplate as far as it tells itself."""
    return never(sig, inside_article) or proposed(sig)


def whole(sig: str) -> bool:
    """Whether this is an article or main element that is no card."""
    return sig.split(".")[0] in ("article", "main") and not proposed(sig)


def walk(page: str) -> Iterator[tuple[str, object]]:
    """A page as events: ("open", signature), ("close", signature), ("text", text) and ("break", None).

    Ends that are left out are supplied, ends without a beginning are skipped, and raw elements have no text.
    Inline elements belong to the text around them and give no events, unless their names mark them as boilerplate.
    """
    stack: list[tuple[str, str | None]] = []
    at, size = 0, len(page)

    def close_to(depth: int):
        while len(stack) > depth:
            if (sig := stack.pop()[1]) is not None:
                yield "close", sig

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            yield "text", page[at:]
            break
        if found.start() > at:
            yield "text", page[at:found.start()]
        at = max(found.end(), found.start() + 1)
        if found[1]:
            tag = found[1].lower()
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                yield from close_to(depth)
            elif tag == "br":
                yield "text", " "
        elif found[2]:
            tag, attrs = found[2].lower(), found[3] or ""
            if tag == "br":
                yield "text", " "
                continue
            wanted, barrier = CLOSES.get(tag, (set(), set()))
            if tag in CLOSE_P:
                wanted, barrier = {"p"}, {"table", "button"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in barrier:
                    break
                if stack[k][0] in wanted:
                    yield from close_to(k)
                    if tag != "tr":
                        break
            if tag in VOID:
                if tag == "hr":
                    yield "break", None
                continue
            sig = signature(tag, attrs)
            if tag in INLINE and not boiler(sig, True):
                if not attrs.endswith("/"):
                    stack.append((tag, None))
                continue
            if len(stack) >= DEEP and tag not in RAW and not boiler(sig, True):
                yield "break", None
                stack.append((tag, None))
                continue
            yield "open", sig
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
                yield "close", sig
            elif not attrs.endswith("/"):
                stack.append((tag, sig))
            else:
                yield "close", sig
    yield from close_to(0)


# An expression is a list of nodes [signature, count, children]; count is one of "1", "?", "+", "*"; a text slot is
# "#", a group of several nodes "()".

def _more(a: str, b: str) -> str:
    """The count that covers both."""
    return {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}[
        a in "?*" or b in "?*", a in "+*" or b in "+*"]


def align(a: list, b: list) -> list:
    """The expression that covers two: equal nodes meet in order, nodes of one side only become optional."""
    if a == b:
        return a
    out = []
    names = [["".join(y[0] for y in x[2]) if x[0] == "()" else x[0] for x in side] for side in (a, b)]
    for kind, i, j, k, m in difflib.SequenceMatcher(None, *names, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [[x[0], _more(x[1], y[1]), align(x[2], y[2])] for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [[x[0], _more(x[1], "?"), x[2]] for x in (*a[i:j], *b[k:m])]
    return fold(out)


def fold(nodes: list) -> list:
    """Neighbours that repeat, singly or in runs of two or three, as one repeated node or group."""
    for width in (1, 2, 3):
        out: list = []
        for node in nodes:
            out.append(node)
            while len(out) >= 2 * width:
                left, right = out[-2 * width:-width], out[-width:]
                if [x[0] for x in left] != [x[0] for x in right] or any(x[0] == "()" for x in left) and width > 1:
                    break
                both = [[x[0], _more(x[1], y[1]), align(x[2], y[2])] for x, y in zip(left, right)]
                del out[-2 * width:]
                out += [[both[0][0], _more(both[0][1], "+"), both[0][2]]] if width == 1 else [["()", "+", both]]
            if width > 1 and len(out) > width and out[-width - 1][0] == "()":      # one more turn of the group before it
                group, tail = out[-width - 1], out[-width:]
                if [x[0] for x in group[2]] == [x[0] for x in tail]:
                    del out[-width:]
                    group[2] = [[x[0], _more(x[1], y[1]), align(x[2], y[2])] for x, y in zip(group[2], tail)]
        nodes = out
    if len(nodes) > MANY:
        kinds: dict[str, list] = {}
        for node in nodes:
            for sig, _, inner in node[2] if node[0] == "()" else [node]:
                kinds[sig] = align(kinds[sig], inner) if sig in kinds else inner
        nodes = [["()", "+", [[sig, "*", inner] for sig, inner in kinds.items()]]]
    return nodes


def page_expression(page: str) -> tuple[list, Counter]:
    """The folded expression of one page, and the characters of its text under each element path."""
    top: list = []
    stack, path, mass = [top], [], Counter()
    for kind, value in walk(page):
        if kind == "text":
            n = len("".join(html.unescape(value).split()))
            if n:
                mass["/".join(path)] += n
                if not stack[-1] or stack[-1][-1][0] != "#":
                    stack[-1].append(["#", "1", []])
        elif kind == "open":
            node = [value, "1", []]
            stack[-1].append(node)
            stack.append(node[2])
            path.append(value)
        elif kind == "close":
            done = stack.pop()
            done[:] = fold(done)
            path.pop()
    return fold(top), mass


@functools.lru_cache(100_000)
def standing(path: str) -> tuple[bool, tuple[str, ...], bool, bool]:
    """Of the elements on a path: whether none of them is never main text, the paths of those proposed as boilerplate, and
    whether an article or main element stands on the path and below the last of them."""
    inside, below, marks = False, False, []
    parts = path.split("/") if path else []
    for k, sig in enumerate(parts):
        if never(sig, inside):
            return False, (), inside, below
        if proposed(sig):
            marks.append("/".join(parts[:k + 1]))
            below = False
        inside = inside or sig.split(".")[0] in ("article", "main")
        below = below or whole(sig)
    return True, tuple(marks), inside, below


def clean(path: str) -> bool:
    """Whether no element on the path is boilerplate as far as names tell."""
    fine, marks, _, _ = standing(path)
    return fine and not marks


def marked(mass: dict[str, int]) -> Counter:
    """Text under each element that is proposed as boilerplate, by its path, and under the empty path all of it; what is never
    main text does not count."""
    total: Counter = Counter()
    for path, n in mass.items():
        fine, marks, _, _ = standing(path)
        if fine:
            for mark in ("", *marks):
                total[mark] += n
    return total


def heavy(mass: dict[str, int]) -> list[str]:
    """Paths of elements proposed as boilerplate that hold most of a host's text: their names do not say what they are."""
    total = marked(mass)
    return sorted(p for p, n in total.items() if p and 2 * n > total[""])


def spared(found: list[tuple[str, str]], held: list[str]) -> set[str]:
    """Paths of proposed elements that are main text on a page: those whose article or main elements hold no less than
    those outside all of them, and, where a page has none outside, those that hold most of the host's text."""
    outside, within = 0, Counter()
    for path, text in found:
        _, marks, inside, below = standing(path)
        if not marks:
            outside += len(text.strip()) if inside else 0
        elif below:
            for mark in marks:
                within[mark] += len(text.strip())
    return {p for p, n in within.items() if n >= max(outside, 1)} | (set() if outside else set(held))


def containers(wrapper: list, mass: dict[str, int], constant: list[tuple[str, str]] = ()) -> dict[str, list]:
    """The rules of a host: under "heavy" see :func:`heavy`, under "template" see :func:`templates`."""
    return {"heavy": heavy(mass), "template": templates(wrapper, constant)}


def templates(wrapper: list, constant: list[tuple[str, str]]) -> list[str]:
    """The keys of text that stands in a slot of the wrapper on every page; ``constant`` has the paths of slots and keys."""
    slots: set[str] = set()

    def visit(nodes: list, above: str):
        for sig, _, inner in nodes:
            if sig == "#":
                slots.add(above)
            else:
                visit(inner, above if sig == "()" else f"{above}/{sig}" if above else sig)

    visit(wrapper, "")
    return sorted(key for path, key in constant if path in slots)


def page_blocks(page: str) -> list[tuple[str, list[tuple[str, str]], list[int]]]:
    """The blocks of a page that hold text outside of what never is main text: path, pieces of text with their paths, and the
    containers around it, numbered over the page, from the outermost in."""
    found, path, held, around = [], [], [], [0]
    opened = 0

    def flush():
        if any(not t.isspace() for _, t in held):
            found.append(("/".join(path), held[:], sorted(set(around))))
        held.clear()

    for kind, value in walk(page):
        if kind == "text":
            here = "/".join(path)
            if standing(here)[0]:
                held.append((here, html.unescape(value)))
            continue
        # An inline element that is boilerplate goes without cutting the block around it.
        tag = None if value is None else value.split(".")[0]
        if tag is None or tag not in INLINE:
            flush()
        if kind == "open":
            opened += 1
            path.append(value)
            around.append(around[-1] if tag in INLINE or tag in TEXTUAL else opened)
        elif kind == "close":
            path.pop()
            around.pop()
    flush()
    return found


def text_key(path: str, pieces: list[tuple[str, str]]) -> str:
    """What tells the text of a block in a slot from other texts and other slots."""
    return hashlib.blake2b(f"{path}\n{' '.join(''.join(t for _, t in pieces).split())}".encode("utf-8", "surrogatepass"), digest_size=10).hexdigest()


def page_texts(page: str) -> tuple[list[tuple[str, str, int]], int]:
    """The different (path, key, characters) of a page's blocks outside article and main elements, and the characters of all."""
    blocks = [(at, pieces, sum(len("".join(t.split())) for _, t in pieces)) for at, pieces, _ in page_blocks(page)]
    return sorted({(at, text_key(at, pieces), n) for at, pieces, n in blocks if not standing(at)[2]}), sum(n for _, _, n in blocks)


def extract(page: str, rules: dict[str, list]) -> str:
    """The main text of a page by its host's rules, all that does not stand in boilerplate and is not the template's.

    One line per block, white space inside a block as one space.
    """
    found = page_blocks(page)
    kept = spared([(here, t) for _, pieces, _ in found for here, t in pieces], rules["heavy"])
    lines = [(" ".join("".join(t for here, t in pieces if kept.issuperset(standing(here)[1])).split()), at, pieces, around) for at, pieces, around in found]
    lines = [x for x in lines if x[0]]
    if rules["template"]:
        shared = set(rules["template"])
        same = [not standing(at)[2] and text_key(at, pieces) in shared for _, at, pieces, _ in lines]
        varied = {k for x, constant in zip(lines, same) if not constant for k in x[3]}
        lines = [x for x, constant in zip(lines, same) if not constant or x[3][-1] in varied]
    return "\n".join(x[0] for x in lines)


def host_of(url):
    """The host of a url in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _counted(pages: DataFrame) -> DataFrame:
    """Rows (host, kind, key, n): equal "page" expressions, "mass" of text as :func:`marked` has it, and the "text" of pages
    outside article and main elements, one row for equal pages."""
    def fold_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: Counter = Counter()
            for host, page in zip(frame["host"], frame["html"]):
                nodes, mass = page_expression(page)
                seen[host, "page", json.dumps(nodes)] += 1
                for path, n in marked(mass).items():
                    seen[host, "mass", path] += n
                texts, total = page_texts(page)
                if texts:
                    which = hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=10).hexdigest()
                    seen[host, "text", json.dumps({"page": which, "total": total, "texts": [dict(zip(("path", "key", "n"), t)) for t in texts]})] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["host", "kind", "key", "n"])

    return durable(pages.select("host", "html").mapInPandas(fold_pages, "host string, kind string, key string, n long")
                   .groupBy("host", "kind", "key").agg(F.sum("n").alias("n")), "expressions")


def _constants(counted: DataFrame) -> DataFrame:
    """Rows (host, constant): the slots outside article and main elements with the one text that stands in each of them on
    all different pages that have the slot, at least SEVERAL.  Hosts of near copies, where such text is more than half of
    all, have none."""
    read = F.from_json("key", "page string, total long, texts array<struct<path:string,key:string,n:long>>")
    texts = counted.where("kind = 'text'").select("host", read.alias("of"))
    slots = (texts.select("host", F.explode(F.array_distinct(F.col("of.texts.path"))).alias("path"))
             .groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= SEVERAL))
    # What varies goes before anything meets.
    same = (texts.select("host", F.inline("of.texts")).groupBy("host", "path", "key")
            .agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n")).where(F.col("pages") >= SEVERAL))
    totals = texts.groupBy("host").agg(F.sum("of.total").alias("total"))
    return (same.join(slots, ["host", "path", "pages"]).groupBy("host")
            .agg(F.collect_list(F.struct("path", "key")).alias("constant"), F.sum("n").alias("n"))
            .join(totals, "host").where(F.col("n") * 2 <= F.col("total")).select("host", "constant"))


def infer_wrappers(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """One row (host, wrapper) per host; ``pages`` has host and html.  wrapper is the expression in JSON."""
    return _aligned(_counted(pages), group)


def _aligned(counted: DataFrame, group: int = GROUP) -> DataFrame:
    """The wrappers of :func:`infer_wrappers` from counted expressions."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        # The commonest first: what is rare is aligned to it, and the order is the same in every run.
        rows = rows.sort_values(["n", "key"], ascending=[False, True])
        whole = None
        for key in rows["key"]:
            nodes = json.loads(key)
            whole = nodes if whole is None else align(whole, nodes)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "key": [json.dumps(whole)], "n": [int(rows["n"].sum())]})

    level = counted.where("kind = 'page'").drop("kind")
    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
        most = sizes.agg(F.max("of")).first()[0] or 0
        if most <= 1:
            break
        dealt = level.join(sizes, "host").withColumn(
            "part", F.pmod(F.xxhash64("key"), F.ceil(F.col("of") / group)) if most > group else F.lit(0).cast("long"))
        level = durable(dealt.groupBy("host", "part").applyInPandas(
            lambda rows: merge(rows), "host string, key string, n long"), "aligned")
    return level.select("host", F.col("key").alias("wrapper"))


def _heavy(counted: DataFrame) -> DataFrame:
    """Rows (host, heavy): :func:`heavy` of each host; an element that holds most is one of few."""
    mass = counted.where("kind = 'mass'")
    total = mass.where("key = ''").select("host", F.col("n").alias("total"))
    return (mass.where("key != ''").join(total, "host").where(F.col("n") * 2 > F.col("total"))
            .groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("heavy")))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id_col``, ``url_col``, text, n_chars (code points of the text).

    Null html counts as empty and gives an empty text; pages without url or host share one wrapper.  Repeated rows
    come out as often as they went in; other columns are not touched; an empty table gives an empty result.
    """
    pages = df.select(col(id_col).alias("id"), col(url_col).alias("url"), text_of(html_col).alias("html"),
                      host_of(col(url_col).cast("string")).alias("host"))

    @F.pandas_udf("string")
    def chosen(wrappers: pd.Series, heavies: pd.Series, constants: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({"heavy": json.loads(h), "template": templates(json.loads(w), [tuple(x) for x in json.loads(c)])})
                          for w, h, c in zip(wrappers, heavies, constants)], dtype="object")

    counted = _counted(pages)
    constants = _constants(counted).select("host", F.to_json(F.transform("constant", lambda x: F.array(x["path"], x["key"]))).alias("constant"))
    held = _heavy(counted).select("host", F.to_json("heavy").alias("heavy"))
    rules = durable(_aligned(counted).join(constants, "host", "left").join(held, "host", "left").select(
        "host", chosen("wrapper", F.coalesce("heavy", F.lit("[]")), F.coalesce("constant", F.lit("[]"))).alias("rules")), "wrappers")

    @F.pandas_udf("string")
    def text(pages: pd.Series, rules: pd.Series) -> pd.Series:
        parsed: dict[str, list] = {}
        return pd.Series([extract(p, parsed.get(x) or parsed.setdefault(x, json.loads(x))) for p, x in zip(pages, rules)], dtype="object")

    return (pages.join(rules, "host").select(F.col("id").alias(id_col), F.col("url").alias(url_col), text("html", "rules").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
