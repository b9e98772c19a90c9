"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a tree of labelled elements and text slots. The wrapper of a host is one expression
that all its pages match: a sequence of elements in which a part is plain, optional (?) or
repeated (+ or *), and text is a slot, constant or not; there are no unions. It is inferred by
aligning token streams one after the other: equal labels are aligned and merged, equal
neighbours fold into a repeated group, also a group of several elements, and what stands on
one side only becomes optional. Alignment of wrappers is the same as of pages, so the wrappers
of partitions are merged in a reduction tree and no task sees all pages of a host.

The wrapper then tells where the article is: menus, headers, footers, sidebars, notices,
adverts, forms and comments are set aside by role, and the article's path is the deepest
element that holds most of the words of the remaining variable slots. Every page is read with
the path of its host; a page on which that path holds nothing is read with its own wrapper.

A class word sets a container aside. A heading, paragraph or other element of text with such a
word is judged by the wrapper: it goes where all its slots are constant on the host's pages.

Trees may be of any depth: nothing here recurses, and wrappers travel as flat lists.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivegrid.llm.common import null_empty, written

FAN_IN = 256
_HOSTS_AT_ONCE = 2000
_SHARE = 0.6

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Which open elements an opening tag ends (and where the search for them stops).
_ENDS_P = BLOCK - frozenset("body html option optgroup caption tbody thead tfoot tr td th legend".split())
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, {"html"}),
}
#: Elements that never belong to the article.
ASIDE_TAGS = frozenset("head nav footer aside script style noscript template iframe svg canvas object select button textarea dialog menu title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar sidebars aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments commentlist respond disqus related recommended pagination pager "
    "toolbar widget".split()
)
_MAIN_TAGS = frozenset(("article", "main"))
_WHOLE = frozenset(("#root", "html", "body"))
#: Elements whose ids are often slugs of their titles.
_SLUGS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
#: Elements of text: a class word alone says little about them.
_TEXT_TAGS = frozenset(
    "h1 h2 h3 h4 h5 h6 p li dt dd td th tr caption blockquote pre figcaption span a b i em strong small mark q cite code u s sub sup abbr time label".split()
)
_NAME_WORDS = re.compile(r"[a-z]+")
#: A quote opens a value after an equals sign only; one that is never closed is a plain character.
_VALUE = r"""=[\s]*+(?:"[^"]*+"|'[^']*+')?+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|{_VALUE})*+)>|<(?=/?[a-zA-Z]).*\Z|[^<]++|<", re.S)
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))?)?""")
_MAYBE = re.compile(r"class|id|role|hidden", re.I)
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass(slots=True)
class Element:
    """An element of a page. ``label``: tag and class words, the same on all pages of a site.
    ``aside``: never in the article. ``weak``: looks set aside by a word of its names, which
    counts outside the article only. ``named``: an element of text with a class word, set
    aside where the host's wrapper shows a constant."""

    tag: str
    label: str
    aside: bool
    weak: bool = False
    named: bool = False
    children: list = field(default_factory=list)  # Element or str


def parse(source: str) -> Element:
    """Tree of a page; forgiving about tags that are missing, crossed or left open. What
    follows a tag that never ends is text."""
    root = Element("#root", "#root", False)
    stack = [root]
    open_: list[Element] = []  # forms and weak elements
    at = 0
    while match := _TOKEN.match(source, at):
        at = match.end()
        token = match[0]
        name = match[2]
        if name is None:
            if token[:2] not in ("<!", "<?"):
                stack[-1].children.append(token)
            if at >= len(source):
                break
            continue
        tag = name.lower()
        if match[1]:
            _close(stack, tag)
        else:
            _open(stack, tag, match[3] or "")
            if stack[-1].weak or tag == "form" and not stack[-1].aside:
                open_.append(stack[-1])
            if tag in RAW:
                end = _end_of(tag).search(source, at)
                end = len(source) if end is None else end.start()
                stack[-1].children.append(source[at:end])
                at = end
            elif tag in VOID:
                stack.pop()
        if at >= len(source):
            break
    if open_:
        _settle(root, open_)
    return root


def _downward(root: Element) -> list[Element]:
    """All elements, every one before those inside it."""
    found, at = [root], 0
    while at < len(found):
        found.extend(c for c in found[at].children if not isinstance(c, str))
        at += 1
    return found


def _settle(root: Element, open_: list[Element]) -> None:
    """Forms are set aside and weak elements stay weak, but for those that hold most words of
    the page: these are plain containers."""
    words: dict[int, int] = {}
    for element in reversed(_downward(root)):
        words[id(element)] = sum(len(c.split()) if isinstance(c, str) else 0 if c.aside else words[id(c)] for c in element.children)
    total = words[id(root)]
    for element in open_:
        small = 2 * words.get(id(element), 0) <= total
        element.weak = element.weak and small
        if element.tag == "form":
            element.aside = small


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I | re.A)


@lru_cache(maxsize=20_000)
def _read_attributes(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Label of an element, whether its attributes set it aside, whether a word of its names
    might, and whether it is an element of text with a class word. Of repeated attributes the
    first counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    names = _NAME_WORDS.findall(found.get("class", "") + " " + found.get("id", ""))
    role = found.get("role", "")
    aside = tag in ASIDE_TAGS or role in _ROLES and (tag, role) != ("form", "form") or "hidden" in found and found["hidden"] != "until-found" or found.get("aria-hidden") == "true"
    weak = named = False
    if tag not in ("html", "body", "main", "article") and not aside:
        word = any(w in _ASIDE_WORDS for w in found.get("class", "").split())
        named = word and tag in _TEXT_TAGS
        aside = word and not named
        weak = not aside and tag not in _SLUGS and any(w in _ASIDE_WORDS for w in names)
    return ".".join([tag, *sorted(set(names))]), aside, weak, named


def _open(stack: list[Element], tag: str, attributes: str) -> None:
    if tag in _ENDS_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in BLOCK:
                break
    if tag in ENDED_BY:
        ends, stops = ENDED_BY[tag]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stops:
                break
            if stack[k].tag in ends:
                del stack[k:]
                if tag != "tr":
                    break
    label, aside, weak, named = _read_attributes(tag, attributes if _MAYBE.search(attributes) else "")
    if weak or tag == "header":
        inside = any(e.tag in _MAIN_TAGS for e in stack)
        aside, weak = aside or tag == "header" and not inside, weak and not inside
    element = Element(tag, label, aside, weak, named)
    stack[-1].children.append(element)
    stack.append(element)


def _close(stack: list[Element], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in ("table", "article", "main", "body") and tag not in ("html", "body", "article", "main", "table", "section", "div"):
            return


# --- wrappers -----------------------------------------------------------------------------
# A part is [count, name, body]. count: "1", "?", "+" or "*". name: the label of an element
# (body: its parts), "#text" (body: [constant or None, words, pages]) or "#group" (body: parts).

_REPEAT = {("1", False): "1", ("1", True): "+", ("?", False): "?", ("?", True): "*", ("+", False): "+", ("+", True): "+", ("*", False): "*", ("*", True): "*"}


def _run(steps):
    """Run a generator that yields the generators it needs results of; no recursion."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def wrapper_of(element: Element) -> list:
    """The wrapper of one page: its tree with repeats folded."""
    made: dict[int, list] = {}
    for e in reversed(_downward(element)):
        parts = []
        for child in e.children:
            if not isinstance(child, str):
                if child.tag not in ("script", "style"):
                    parts.append(made.pop(id(child)))
                continue
            words = child.split()
            if words and parts and parts[-1][1] == "#text":
                parts[-1][2][0].extend(words)
            elif words:
                parts.append(["1", "#text", [words, 0, 1]])
        for part in parts:
            if part[1] == "#text":
                words = part[2][0]
                text = " ".join(words[:81])  # longer text is never a template's
                part[2][:2] = [text if len(text) <= 80 else None, len(words)]
        name = ("!" if e.aside or e.weak or e.named else "") + e.label
        made[id(e)] = ["1", name, fold(parts)]
    return made[id(element)]


def _alike(a: list, b: list) -> bool:
    return a[1] == b[1] and (a[1] != "#group" or [p[1] for p in a[2]] == [p[1] for p in b[2]])


def fold(parts: list) -> list:
    """Fold neighbouring repeats of a group of up to four parts into one repeated part."""
    return _run(_fold(parts))


def merge(a: list, b: list) -> list:
    """The wrapper of two parts of one name."""
    return _run(_merge(a, b))


def align(a: list, b: list) -> list:
    """Merge two part sequences: the longest common sequence of names is merged, the rest
    becomes optional; neighbours that are now alike are folded."""
    return _run(_align(a, b))


def _fold(parts: list):
    for width in (1, 2, 3, 4):
        if len(parts) < 2 * width:
            break
        out: list = []
        k = 0
        while k < len(parts):
            group = parts[k:k + width]
            times = 1
            while len(group) == width and k + (times + 1) * width <= len(parts) and all(map(_alike, group, parts[k + times * width:k + (times + 1) * width])):
                times += 1
            if times == 1 or all(p[1] == "#text" for p in group):
                out.append(parts[k])
                k += 1
                continue
            merged = group
            for t in range(1, times):
                row = []
                for x, y in zip(merged, parts[k + t * width:k + (t + 1) * width]):
                    row.append((yield _merge(x, y)))
                merged = row
            if width == 1:
                merged[0][0] = _REPEAT[merged[0][0], True]
                out.append(merged[0])
            else:
                out.append(["+", "#group", merged])
            k += times * width
        parts = out
    return parts


def _both(a: str, b: str) -> str:
    optional = a in "?*" or b in "?*"
    return _REPEAT["?" if optional else "1", a in "+*" or b in "+*"]


def _merge(a: list, b: list):
    count = _both(a[0], b[0])
    if a[1] == "#text":
        return [count, "#text", [a[2][0] if a[2][0] == b[2][0] else None, a[2][1] + b[2][1], a[2][2] + b[2][2]]]
    return [count, a[1], (yield _align(a[2], b[2]))]


def _align(a: list, b: list):
    head, most = 0, min(len(a), len(b))
    while head < most and _alike(a[head], b[head]):
        head += 1
    tail = 0
    while tail < most - head and _alike(a[-1 - tail], b[-1 - tail]):
        tail += 1
    out = []
    for x, y in zip(a[:head], b[:head]):
        out.append((yield _merge(x, y)))
    i, j = head, head
    for p, q in _common(a[head:len(a) - tail], b[head:len(b) - tail]):
        p, q = p + head, q + head
        out += [[_both("?", x[0]), *x[1:]] for x in (*a[i:p], *b[j:q])]
        out.append((yield _merge(a[p], b[q])))
        i, j = p + 1, q + 1
    out += [[_both("?", x[0]), *x[1:]] for x in (*a[i:len(a) - tail], *b[j:len(b) - tail])]
    for x, y in zip(a[len(a) - tail:], b[len(b) - tail:]):
        out.append((yield _merge(x, y)))
    return (yield _fold(out))


def _key(part: list) -> tuple:
    return (part[1], *(p[1] for p in part[2])) if part[1] == "#group" else (part[1],)


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common sequence of names: the longest rising run through the
    places at which they are equal, so its cost grows with these and not with all pairs."""
    places = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        places[_key(b[j])].append(j)
    ends: list[int] = []  # smallest end of a common sequence of each length
    links: list[tuple | None] = []
    for i, part in enumerate(a):
        for j in places.get(_key(part), ()):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append((link[0], link[1]))
        link = link[2]
    return out[::-1]


def flat(wrapper: list) -> list:
    """A wrapper as one list: counts, names and sizes (of text: the slot), outside first."""
    out, todo = [], [wrapper]
    while todo:
        part = todo.pop()
        out += [part[0], part[1], part[2] if part[1] == "#text" else len(part[2])]
        if part[1] != "#text":
            todo.extend(reversed(part[2]))
    return out


def unflat(items: list) -> list:
    """The wrapper again."""
    top: list = []
    open_: list[tuple[list, int]] = [(top, 1)]
    for k in range(0, len(items), 3):
        count, name, size = items[k:k + 3]
        part = [count, name, size if name == "#text" else []]
        while len(open_[-1][0]) == open_[-1][1]:
            open_.pop()
        open_[-1][0].append(part)
        if name != "#text" and size:
            open_.append((part[2], size))
    return top[0]


def article_path(wrapper: list) -> list[str]:
    """Names from the root to the element that holds the article."""
    parts = [(wrapper, -1)]  # every part before those inside it, with its owner
    at = 0
    while at < len(parts):
        part = parts[at][0]
        if part[1] != "#text" and part[1][0] != "!":
            parts.extend((p, at) for p in part[2])
        at += 1
    words = [0] * len(parts)
    for k in range(len(parts) - 1, -1, -1):
        part, owner = parts[k]
        if part[1] == "#text" and (part[2][0] is None or part[2][2] == 1):
            words[k] += part[2][1]
        if owner >= 0:
            words[owner] += words[k]
    total = words[0]
    marked = _marked(parts, words)
    if marked is not None and words[marked] >= 0.3 * total:
        return _path_to(parts, marked)
    inner = defaultdict(list)  # elements inside an element, groups looked through
    holder = [-1] * len(parts)
    for k, (part, owner) in enumerate(parts):
        holder[k] = owner if owner < 0 or parts[owner][0][1] != "#group" else holder[owner]
        if part[1] not in ("#text", "#group") and part[1][0] != "!" and k:
            inner[holder[k]].append(k)
    here = 0
    while True:
        best = max(inner[here], key=words.__getitem__, default=None)
        if best is None:
            break
        part = parts[best][0]
        if part[1].split(".")[0] not in BLOCK or part[0] in "+*" or words[best] < _SHARE * max(total, 1):
            break
        here = best
    return _path_to(parts, here)


def _path_to(parts: list, k: int) -> list[str]:
    path = []
    while k >= 0:
        if parts[k][0][1] != "#group":
            path.append(parts[k][0][1])
        k = parts[k][1]
    return path[::-1]


def _marked(parts: list, words: list[int]) -> int | None:
    """The article or main element with most words, the innermost of nested ones."""
    best: list[int | None] = [None] * len(parts)
    for k in range(len(parts) - 1, -1, -1):
        part, owner = parts[k]
        if part[1] == "#text" or part[1][0] == "!":
            continue
        if part[1].split(".")[0] in _MAIN_TAGS and (best[k] is None or words[best[k]] < 0.9 * words[k]):
            best[k] = k
        # going backwards, an earlier part wins a tie
        if owner >= 0 and best[k] is not None and (best[owner] is None or words[best[k]] >= words[best[owner]]):
            best[owner] = best[k]
    return best[0]


def constant_labels(wrapper: list) -> list[str]:
    """Labels of set-aside elements of text whose slots are all constant over several pages."""
    found: dict[str, bool] = {}
    todo = [(wrapper, None)]
    while todo:
        part, within = todo.pop()
        if part[1] == "#text":
            if within is not None:
                found[within] = found.get(within, True) and part[2][0] is not None and part[2][2] > 1
            continue
        if within is None and part[1][0] == "!" and part[1][1:].split(".")[0] in _TEXT_TAGS:
            within = part[1][1:]
        todo.extend((p, within) for p in part[2])
    return sorted(k for k, v in found.items() if v)


# --- reading pages ------------------------------------------------------------------------

def _at_path(element: Element, path: list[str]) -> list[Element]:
    here = [element]
    for name in path[1:]:
        here = [c for e in here for c in e.children if isinstance(c, Element) and not c.aside and not c.weak and c.label == name]
    return here


def blocks_of(element: Element, constant: frozenset = frozenset()) -> list[str]:
    """Texts of the blocks below an element in page order; what stands aside is left out,
    by a word of its names only where the whole page is read, an element of text with a class
    word where its label is in ``constant``."""
    whole = element.tag in _WHOLE
    out: list[str] = []
    run: list[str] = []

    def end():
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [iter([element])]
    closing: list[bool] = [False]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            if closing.pop():
                end()
        elif isinstance(child, str):
            run.append(child)
        elif child.tag == "br":
            run.append(" ")
        elif not (child.aside or whole and child.weak or child.named and child.label in constant):
            block = child.tag in BLOCK
            if block:
                end()
            todo.append(iter(child.children))
            closing.append(block)
        elif child.tag in BLOCK:
            end()
    end()
    return out


def main_text(source: str, path: list[str] | None, constant: frozenset = frozenset()) -> str:
    page = parse(source)
    if path:
        found = [b for e in _at_path(page, path) for b in blocks_of(e, constant)]
        if found:
            return "\n\n".join(found)
    return "\n\n".join(b for e in _at_path(page, article_path(wrapper_of(page))) for b in blocks_of(e, constant))


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST, 1))


def infer_wrappers(df: DataFrame, url: str = "url", source: str = "html", fan_in: int = FAN_IN) -> DataFrame:
    """``host, wrapper, path, constant``: one wrapper per host from all its pages (JSON)."""

    def collect(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[str, list] = {}
        for pdf in batches:
            for host, text in zip(pdf["host"], pdf["html"]):
                one = wrapper_of(parse(text))
                held[host] = merge(held[host], one) if host in held else one
                if len(held) >= _HOSTS_AT_ONCE:
                    yield _table(held, part)
                    held = {}
        if held:
            yield _table(held, part)

    def _table(held, part):
        return pd.DataFrame({"host": list(held), "part": part, "wrapper": [json.dumps(flat(w)) for w in held.values()]})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(pdf["wrapper"]):
            one = unflat(json.loads(text))
            whole = one if whole is None else merge(whole, one)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [int(pdf["part"].iloc[0])], "wrapper": [json.dumps(flat(whole))]})

    schema = "host string, part long, wrapper string"
    level = written(df.select(_host(url).alias("host"), null_empty(source).alias("html")).mapInPandas(collect, schema))
    width = (level.agg(F.max("part")).first()[0] or 0) + 1
    while True:  # parts of a host are merged fan_in at a time
        width = -(-width // fan_in)
        level = level.withColumn("part", F.expr(f"part div {fan_in}L"))
        level = written(level.groupBy("host", "part").applyInPandas(combine, schema))
        if width <= 1:
            break

    def paths(batches):
        for pdf in batches:
            found = [unflat(json.loads(w)) for w in pdf["wrapper"]]
            yield pdf[["host", "wrapper"]].assign(path=[json.dumps(article_path(w)) for w in found], constant=[json.dumps(constant_labels(w)) for w in found])

    return level.select("host", "wrapper").mapInPandas(paths, "host string, wrapper string, path string, constant string")


def extract(df: DataFrame, row_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: one row per input row.

    A null html is empty and gives an empty text; pages without a host (null or odd url) share
    one wrapper. Repeated rows and null ids are returned as they come; further columns are
    ignored; an empty table gives no rows.
    """
    wrappers = written(infer_wrappers(df, url, source).select("host", "path", "constant"))
    rows = df.select(F.col(row_id).cast("long").alias("page_id"), F.col(url).alias("url"), null_empty(source).alias("html"), _host(url).alias("host"))

    def read_pages(batches):
        for pdf in batches:
            hosts = {p: (json.loads(p), frozenset(json.loads(c))) for p, c in set(zip(pdf["path"], pdf["constant"])) if p}
            text = [main_text(h, *hosts.get(p, (None,))) for h, p in zip(pdf["html"], pdf["path"])]
            out = pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text})
            yield out.assign(n_chars=[len(t) for t in text])

    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "path", "constant")
    return joined.mapInPandas(read_pages, "page_id long, url string, text string, n_chars long")
