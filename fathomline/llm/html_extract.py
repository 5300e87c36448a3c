"""Operator 8: main text of web pages as the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words score positive and tags negative, and one linear scan (the running
sum, restarted where it falls to zero) finds the contiguous run of greatest sum: the article. How much a word counts is
the least score of the elements around it, from -1 to 1, and words below zero are left out of the run: menus, notices
and adverts inside the article. The scores are linear in features of an element: its name, its class, id and role
tokens, whether they are known names of boxes, the share of its words in links, its size, its punctuation, and where it
lies against the smallest element that holds most of the words and the title. No element goes by its name alone, but
for hidden ones.

All weights are fitted to labelled pages, those that mark their article with an element of their own, which the scan
never reads: element weights by logistic regression, weights of words and tags by a structured perceptron. Each
labelled page trains in five forms (``_forms``): with its mark as a plain div, without it, cut to a short article, with boxes of
other pages' words before, in and after the article, and with the article's paragraphs recast as
headings, lists and tables that carry names of boxes, as does what holds the title.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import text_batches, texts, unique_names

#: Bound of the labelled pages that the weights are fitted on, of the characters of each, and rounds over them.
TRAINING_PAGES, TRAINING_CHARS, ROUNDS = 400, 200_000, 4
#: Steps, rate and decay of the logistic regression.
STEPS, RATE, DECAY = 400, 0.5, 1e-4
WORD, ASIDE = "word", "aside"
FIRST_WORD, FIRST_TAG, LEAST = 1.0, -1.0, 0.05
#: Elements whose text is never shown, elements that hold no article text, void elements, block elements.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that are text themselves; all others are boxes.
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "details", "summary"}
#: Names of boxes in class, id and role tokens, and words that follow them.
BOXES = (
    "ad ads advert advertisement alert banner bottom breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion "
    "footer header masthead menu nav navbar navigation newsletter notice popup promo promotion related replies search share sharing sidebar "
    "signup social sponsor sponsored subscribe thread toolbar topbar widget"
).split()
_BOX = set(BOXES)
_AFTER = "area bar box buttons container content form icons inner items links list media section slot unit wrapper".split()
#: Marks of labelled pages; the scan sees them as if they were not there.
LABEL = {"article", "main"}
_REST = r"|<[!?][^>]*+>|</[^a-zA-Z][^>]*+>|</>|[^<]++|<(?![a-zA-Z/!?])"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>" + _REST, re.DOTALL)
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>" + _REST, re.DOTALL)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)")
_STYLE = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none|display:none)", re.IGNORECASE)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
UNSEEN = "\0hidden"
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", name, class and id), ("close", name, "") and ("text", text, "") of a page; comments, hidden elements and their tags are left out.

    From the first tag with an unclosed quote on, a tag ends at the next >, quoted or not; a tag without an end ends the
    page. A script or style without an
    end hides the rest of the page, another hidden element without an end hides nothing.
    """
    at, n, last, shape = 0, len(page), page.rfind(">"), _TOKEN
    endless: set[str] = set()
    while at < n:
        m = shape.match(page, at)
        if m is None:
            if at > last:  # a tag without an end
                return
            shape = _PLAIN
            continue
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if name in HIDDEN and not m[1]:
                if name == "head":
                    end = re.compile(r"</head\s*>|<body\b", re.IGNORECASE).search(page, at)
                    at = (end.start() if end[0][1] != "/" else end.end()) if end else at
                elif not m[3].endswith("/") and name not in endless:
                    end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
                    if end:
                        at = end.end()
                    elif name in ("script", "style"):
                        at = n
                    else:
                        endless.add(name)
                continue
            if name in HIDDEN:
                continue
            marks = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(m[3])).lower() if "=" in m[3] else ""
            if m[3] and not m[1] and (_UNSEEN.search(_QUOTED.sub("", m[3].lower())) or _STYLE.search(m[3])):
                marks = f"{marks} {UNSEEN}"
            yield "close" if m[1] else "open", name, marks
        elif m[0][0] != "<" or m[0] == "<":
            yield "text", m[0], ""


def _box_names(marks: str) -> set[str]:
    """How class, id and role tokens name a box: "whole" by a token of its own, "last" or "first" by its last or first part."""
    out = set()
    for token in marks.split():
        parts = [x for x in re.split(r"[-_]+", token) if x]
        if not parts:
            continue
        if parts[0] in _BOX and all(x in _BOX or x in _AFTER for x in parts[1:]):
            out.add("whole")
        elif parts[-1] in _BOX:
            out.add("last")
        elif parts[0] in _BOX:
            out.add("first")
    return out


def _ends(found: list[tuple[str, str, str]]) -> dict[int, int]:
    """For each opening tag where its element ends: at its closing tag, a paragraph at the next block, else where the element around it ends."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    stack: list[int] = []

    def close(name: str, at: int) -> None:
        while stack:
            k = stack.pop()
            open_[found[k][1]].pop()
            ends[k] = at
            if found[k][1] == name:
                break

    for i, (kind, name, _) in enumerate(found):
        if kind == "open" and name not in VOID:
            if name in BLOCKS and open_.get("p"):
                close("p", i)
            open_.setdefault(name, []).append(i)
            stack.append(i)
        elif kind == "close" and open_.get(name):
            close(name, i)
    return ends | {k: len(found) for k in stack}


def _elements(found: list[tuple[str, str, str]]) -> Iterator[tuple[int, int, tuple[str, ...] | None]]:
    """Start, end and features of each block with words; None for a hidden one. Elements that hold the middle of the page aren't listed.

    The middle is the smallest box with more than half of the words outside links that holds an h1 if the box around it does.
    """
    ends = _ends(found)
    words, free, stops, titles, linked = [0], [0], [0], [0], 0
    for i, (kind, name, _) in enumerate(found):
        n = len(name.split()) if kind == "text" else 0
        if kind == "open" and name == "a" and ends.get(i, i) > linked:
            linked = ends[i]
        words.append(words[-1] + n)
        free.append(free[-1] + (n if i >= linked else 0))
        stops.append(stops[-1] + (len(re.findall(r"[.!?]\s", name + " ")) if kind == "text" else 0))
        titles.append(titles[-1] + (kind == "open" and name == "h1"))
    within = lambda sums, i, e: sums[e] - sums[i]
    start, end = 0, len(found)
    inner = None
    for i, (kind, name, _) in enumerate(found):
        if kind == "open" and i in ends and name in BLOCKS and name not in FLOW and 2 * within(free, i, ends[i]) > free[-1]:
            if within(titles, i, ends[i]) or not within(titles, start, end):
                start, end = i, ends[i]
            else:
                inner = (i, ends[i])
                break
    for i, (kind, name, marks) in enumerate(found):
        if kind != "open" or i not in ends or name not in BLOCKS and not marks:
            continue
        name = "div" if name in LABEL else name
        e = ends[i]
        if marks.endswith(UNSEEN):
            yield i, e, None
            continue
        n = within(words, i, e)
        if i <= start and e >= end or not n or name in ("html", "body"):
            continue
        group = "flow" if name in FLOW else "box"
        place = "before" if e <= start else "after" if i >= end else "in"
        links = 1 - within(free, i, e) / n
        out = [
            "bias", f"name:{name}", f"place:{place}", f"place:{place}:{group}", f"links:{group}:{min(3, int(links * 4))}",
            f"size:{group}:{min(4, len(str(n)))}", f"stops:{group}:{min(2, within(stops, i, e))}", f"share:{group}:{min(3, 10 * n // max(1, words[-1]))}",
        ]
        if within(titles, i, e):
            out.append(f"title:{name}:{place}")
        if inner and (e <= inner[0] or i >= inner[1]):
            out.append("beside:" + ("before" if e <= inner[0] else "after"))
        out += [f"box:{x}:{group}:{place}" for x in sorted(_box_names(marks))]
        out += [f"token:{x}:{group}:{place}" for x in sorted(set(marks.split()))]
        yield i, e, tuple(out)


def _sure(found: list[tuple[str, str, str]], weights: dict[str, float]) -> list[float]:
    """For each token the least score of the elements around it, from -1 to 1; 1 outside all that are scored."""
    at: dict[int, tuple[int, float]] = {}
    for i, e, features in _elements(found):
        x = -1.0 if features is None else sum(weights.get("e|" + f, FIRST_WORD if f == "bias" else 0.0) for f in features)
        at[i] = (e, max(-1.0, min(1.0, x)))
    out, around = [], [(len(found) + 1, 1.0)]
    for i in range(len(found)):
        while around[-1][0] <= i:
            around.pop()
        if i in at:
            around.append((min(at[i][0], around[-1][0]), min(at[i][1], around[-1][1])))
        out.append(around[-1][1])
    return out


def sequence(found: list[tuple[str, str, str]], weights: dict[str, float]) -> list[tuple[str, float]]:
    """Feature and amount of each word run and tag of a page: words by how surely they are article text, tags by name."""
    out = []
    for (kind, name, _), sure in zip(found, _sure(found, weights), strict=True):
        if kind == "text":
            out.append((WORD if sure >= 0 else ASIDE, len(name.split()) * abs(sure)))
        else:
            out.append((f"{kind}:{'div' if name in LABEL else name}", 1.0))
    return out


def _scores(weights: dict[str, float], features: list[tuple[str, float]]) -> list[float]:
    return [n * weights.get(f, FIRST_WORD if f == WORD else FIRST_TAG) for f, n in features]


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of greatest sum; the first of equals, (0, 0) if none is positive."""
    best, run, start, at = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, at = run, (start, i + 1)
    return at


def _sums(features: list[tuple[str, float]]) -> dict[str, float]:
    out: dict[str, float] = {}
    for f, n in features:
        out[f] = out.get(f, 0.0) + n
    return out


Labelled = tuple[list[tuple[str, str, str]], list[bool]]


def _labelled(page: str) -> Labelled | None:
    """Tokens of a page and whether each lies in its mark; None without words in a mark."""
    found, inside, depth = list(tokens(page)), [], 0
    for kind, name, _ in found:
        if name in LABEL and kind != "text":
            depth = max(0, depth + (1 if kind == "open" else -1))
        inside.append(depth > 0 or kind == "close" and name in LABEL)
    return (found, inside) if any(x and k == "text" and t.strip() for (k, t, _), x in zip(found, inside, strict=True)) else None


def _box(rng: random.Random, texts_: list[str], links: bool) -> list[tuple[str, str, str]]:
    """A box that is no article text, with words of other pages."""
    name = rng.choice(BOXES)
    token = rng.choice([name, f"{rng.choice('page site main top'.split())}-{name}", f"{name}-{rng.choice(_AFTER)}"])
    element = rng.choice(["div", "div", "section", "aside"])
    out = [("open", element, token)]
    for _ in range(rng.randint(1, 5)):
        t = " ".join(rng.choice(texts_).split()[: rng.choice([3, 12, 60])])
        out += [("open", "li" if links else "p", ""), *([("open", "a", "")] if links else []), ("text", t, ""), *([("close", "a", "")] if links else []), ("close", "li" if links else "p", "")]
    return [*out, ("close", element, "")]


#: What a recast paragraph holds inside.
_INNER = {"table": ["tr", "td"], "ul": ["li"]}


def _forms(page: Labelled, texts_: list[str], rng: random.Random) -> Iterator[Labelled]:
    """A labelled page in five forms: its mark as it is, without it, cut to a short article, among and with boxes, with paragraphs recast, box names on them and round the title."""
    found, inside = page
    yield page
    bare = [i for i, (k, n, _) in enumerate(found) if k == "text" or n not in LABEL]
    yield [found[i] for i in bare], [inside[i] for i in bare]
    first, last = inside.index(True), len(inside) - inside[::-1].index(True)
    shown = [i for i in range(first, last) if inside[i] and found[i][0] == "text" and found[i][1].strip()]
    if len(shown) > 2:  # a title and one paragraph
        end = next((i for i in range(shown[1], last - 1) if found[i][:2] == ("close", "p")), last - 1) + 1
        yield [*found[:end], *found[last - 1 :]], [*inside[:end], *inside[last - 1 :]]
    gaps = [i for i in range(first + 1, last) if inside[i] and found[i][0] == "open" and found[i][1] == "p"]
    starts, opened = {}, None  # whole paragraphs of the article
    for i in range(first + 1, last):
        if found[i][0] != "text" and found[i][1] in BLOCKS:
            if found[i][:2] == ("close", "p") and opened is not None:
                starts[opened] = i
            opened = i if i in gaps else None
    mid = rng.choice(gaps) if gaps else None
    site = [("open", "header", ""), ("open", "h1", ""), ("text", " ".join(rng.choice(texts_).split()[:3]), ""), ("close", "h1", ""), ("close", "header", "")]
    unknown = [("open", "div", ""), ("open", "p", ""), ("text", " ".join(rng.choice(texts_).split()[:20]), ""), ("close", "p", ""), ("close", "div", "")]
    out: Labelled = ([], [])
    for i in range(len(found) + 1):
        put = []
        if i == first:
            put = [*site, *_box(rng, texts_, rng.random() < 0.5)]
        if i == mid:
            put = _box(rng, texts_, rng.random() < 0.5)
        if i == last:
            put = [*unknown, *_box(rng, texts_, False), ("open", "p", rng.choice(BOXES)), ("text", " ".join(rng.choice(texts_).split()[:8]), ""), ("close", "p", "")]
        out[0].extend(put)
        out[1].extend([False] * len(put))
        if i < len(found):
            out[0].append(found[i])
            out[1].append(inside[i])
    yield out
    own: Labelled = ([], [])
    until, recast, end = None, "", -1
    headed = rng.choice(["", "div", "div", "header"])
    for i, (t, x) in enumerate(zip(found, inside, strict=True)):
        if i in starts:
            end, recast = starts[i], rng.choice(["p", "p", "p", "h2", "h3", "table", "ul", "blockquote", "pre"])
            if until is None and rng.random() < 0.3:
                until = end
                own[0].append(("open", "section", f"{rng.choice(BOXES)}-{rng.choice(('work', 'prices', 'laws', 'story', 'history'))}"))
                own[1].append(True)
        kind, name, marks = t
        if i <= end and kind == "text" and recast in ("h2", "h3", "table"):
            name = " ".join(name.split()[: rng.choice([2, 5])])
        elif i <= end and name == "p":
            name = recast
        if x and kind == "open" and name in FLOW and rng.random() < 0.4:
            marks = rng.choice(BOXES)
        inner = _INNER.get(name, []) if name == recast and i <= end else []
        parts = [(kind, name, marks), *((kind, y, "") for y in inner)] if kind != "close" else [*((kind, y, "") for y in reversed(inner)), (kind, name, marks)]
        if x and name == "h1" and headed:
            tag = ("open", headed, f"{rng.choice('article entry page post story'.split())}-{rng.choice(BOXES)}") if kind == "open" else ("close", headed, "")
            parts = [tag, *parts] if kind == "open" else [*parts, tag]
        own[0].extend(parts)
        own[1].extend([x] * len(parts))
        if i == until:
            until = None
            own[0].append(("close", "section", ""))
            own[1].append(True)
    yield own


def _fit_elements(pages: list[Labelled]) -> dict[str, float]:
    """Weights of element features by logistic regression; elements that only partly lie in the article, and those in an element outside it, don't train."""
    seen: Counter[tuple[tuple[str, ...], bool]] = Counter()
    for found, inside in pages:
        on = list(accumulate((k == "text" and bool(t.strip()) and x for (k, t, _), x in zip(found, inside, strict=True)), initial=0))
        of = list(accumulate((k == "text" and bool(t.strip()) for k, t, _ in found), initial=0))
        outside = 0
        for i, e, features in _elements(found):
            n, all_ = on[e] - on[i], of[e] - of[i]
            if features and n in (0, all_) and i >= outside:
                outside = outside if n else e
                seen[features, n > 0] += 1
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in seen for f in fs}))}
    rows = np.array([r for r, (fs, _) in enumerate(seen) for _ in fs], dtype=np.int64)
    cols = np.array([names[f] for fs, _ in seen for f in fs], dtype=np.int64)
    want = np.array([y for _, y in seen], dtype=float)
    share = np.sqrt(np.array(list(seen.values()), dtype=float))
    share /= np.where(want > 0, max(1.0, share[want > 0].sum()), max(1.0, share[want == 0].sum())) * 2
    w, pace = np.zeros(len(names)), np.zeros(len(names))
    for _ in range(STEPS):
        z = np.bincount(rows, weights=w[cols], minlength=len(want))
        g = np.bincount(cols, weights=(share * (want - 1 / (1 + np.exp(-z))))[rows], minlength=len(names)) - DECAY * w
        pace += g * g
        w += RATE * g / (np.sqrt(pace) + 1e-9)
    return {"e|" + f: float(w[i]) for f, i in names.items()}


def fit(pages: list[str]) -> dict[str, float]:
    """Weights of elements, then of words and tags by a structured perceptron: words stay positive, tags negative."""
    labelled = [x for x in map(_labelled, pages) if x]
    if not labelled:
        return {}
    texts_ = [t for found, inside in labelled for (k, t, _), x in zip(found, inside, strict=True) if x and k == "text" and t.strip()]
    rng = random.Random(0)
    forms = [f for page in labelled for f in _forms(page, texts_, rng)]
    weights = _fit_elements(forms)
    runs = []
    for found, inside in forms:
        on = [i for i, x in enumerate(inside) if x and found[i][0] == "text" and found[i][1].strip()]
        runs.append((sequence(found, weights), on[0], on[-1] + 1))
    for _ in range(ROUNDS):
        wrong = 0
        for features, a, b in runs:
            s, e = best_run(_scores(weights, features))
            words = [i for i in range(s, e) if features[i][0] == WORD and features[i][1]]
            if words and (words[0], words[-1] + 1) == (a, b):
                continue
            wrong += 1
            want, got = _sums(features[a:b]), _sums(features[s:e])
            for f in want.keys() | got.keys():
                step = (want.get(f, 0.0) - got.get(f, 0.0)) * (0.002 if f in (WORD, ASIDE) else 1.0)
                new = weights.get(f, FIRST_WORD if f == WORD else FIRST_TAG) + step
                weights[f] = max(LEAST, new) if f == WORD else min(-LEAST, new)
        if not wrong:
            break
    return weights


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best run, one a line, without the words in it that score below zero."""
    if not page:
        return ""
    found = list(tokens(page))
    features = sequence(found, weights)
    start, end = best_run(_scores(weights, features))
    blocks: list[list[str]] = [[]]
    for i in range(start, end):
        kind, name, _ = found[i]
        if kind == "text":
            if features[i][0] == WORD:
                blocks[-1].append(name)
        elif name in BLOCKS:
            blocks.append([])
        elif name == "br":
            blocks[-1].append(" ")
    lines = (" ".join(_html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, html_col: str = "html", key_col: str = "page_id") -> dict[str, float]:
    """Weights from the TRAINING_PAGES pages that mark their article, have TRAINING_CHARS characters at most and the smallest hashes of
    ``key_col`` and page, at every size of the table."""
    marked = pages.where((F.length(html_col) <= TRAINING_CHARS) & F.col(html_col).rlike(r"(?i)<(article|main)[\s>]")).select(html_col, F.xxhash64(key_col, html_col).alias("_order"))
    first = lambda rows: [r[0] for r in rows.orderBy("_order", html_col).limit(TRAINING_PAGES).collect()]
    n = marked.count()
    if n > 4 * TRAINING_PAGES:  # below this bound lie about twice the pages wanted, so that tasks send the driver few more than it keeps
        found = first(marked.where(F.col("_order") < int(2**65 * TRAINING_PAGES / n) - 2**63))
        if len(found) == TRAINING_PAGES:
            return fit(found)
    return fit(first(marked))


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html", keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns with the main text of each page as ``text_col``: its blocks in page order, one a line.

    Character references are decoded, white space in a block is one space. A null or empty page, and one without
    words, has the empty text. Repeated rows stay; a page is read where it lies, without a shuffle.
    """
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    at = [pages.columns.index(c) for c in keep]
    (name,) = unique_names(pages.select(*keep), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([main_text(p, weights) for p in texts(batch.column(html_col))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), out], names=[*keep, name])

    return text_batches(pages).mapInArrow(run, T.StructType([*(pages.schema.fields[i] for i in at), T.StructField(name, T.StringType(), False)]))
