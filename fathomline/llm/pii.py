"""Operator 7: personal data by weak supervision.

Labelers vote on candidate spans: what else a span of its shape may be (an identifier, a date, a path of words, a number
of a list), checksums and word lists, and the words before the span. How often each labeler is right is estimated without labels by expectation-maximisation over the counts of
vote patterns, which Spark sums over all documents (their number is bounded by the labelers, not by the data).
The posteriors then train a logistic classifier on what a span looks like (its kind, length, kinds of characters and the
word before it) and on its votes; it decides the spans beyond the base rules.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import CARRIED, carry, materialize, text_batches, texts, unpack

#: Kinds in the order of reports; the first four have base rules.
KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "iban"]
BASE_KINDS = KINDS[:4]
#: Shapes of the base rules and of further candidates.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never ends before a digit, so a start inside a run of digits cannot succeed where its beginning failed
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MORE = {
    "email": re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{2,})+"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: Words that speak for a kind when they stand shortly before it, and last labels of host names.
_CONTEXT = {
    "email": {"email", "mail", "contact", "write", "reach", "address"},
    "ip": {"ip", "host", "server", "address", "from", "login"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "account"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "contact"},
    "secret": {"token", "key", "secret", "password", "passwd", "apikey", "api_key", "access_key", "bearer"},
    "ssn": {"ssn", "social", "security", "number"},
    "iban": {"iban", "account", "bank", "konto"},
}
_AGAINST = {"version", "section", "chapter", "figure", "isbn", "issn", "order", "invoice", "id", "sha1", "sha256", "md5", "commit", "checksum"}
_TOP = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "info", "biz", "co", "dev", "app", "example"}
#: Words before a number that is one of a list.
_COUNTED = {"row", "rows", "figure", "fig", "table", "page", "pages", "line", "lines", "part", "model", "section", "chapter", "equation", "step", "item", "no", "nr", "between", "range"}
_UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
_DATE = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}[-/](?:0?[1-9]|1[0-2])(?:[-/](?:0?[1-9]|[12][0-9]|3[01]))(?![0-9])")
_DIGEST = re.compile(r"(?i)[0-9a-f]{32}(?:[0-9a-f]{8}|[0-9a-f]{32})?")
_CODE = re.compile(r"\+[0-9]{1,3} ?$")
_PART = re.compile(r"[-_/+=]+")
#: Characters before a span that context labelers read.
CONTEXT_CHARS = 32
#: Votes: form, checksum or word list, words before, words against. Each is 0 (none), 1 (for) or 2 (against).
LABELERS = 4
EM_ROUNDS, FIT_ROUNDS, MIN_PROBABILITY = 50, 300, 0.5
#: Slots of the word before a span; with the kinds of characters and lengths they bound the number of patterns. Weight of the classifier's penalty.
WORD_SLOTS, PENALTY = 16, 0.01
_KINDS_OF_CHARS = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]

CANDIDATE = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("base", T.BooleanType(), False), T.StructField("votes", T.StringType(), False)]), False
)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email shape, in linear time: from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = done = m.end()
            yield start, end
        else:
            done = max(done, at + 1) if start == at else done
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by start, then kind as listed; failing matches are dropped and not retried."""
    out: list[tuple[int, int, str, int]] = []
    if "@" in text:
        out += [(a, 0, "email", b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:] or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def _form(kind: str, s: str, lead: str, before: list[str]) -> int:
    """The form labeler: whether a further candidate reads as something else of its shape (2), as its kind (1), or neither."""
    if kind == "secret":
        parts = _PART.split(s)
        words = sum(len(x) for x in parts if len(x) >= 3 and x.isalpha() and (x.islower() or x.istitle()))
        if _DIGEST.fullmatch(s):
            return 0
        if _UUID.search(s) or _DATE.search(s) or 2 * words >= len(s):
            return 2
        n = len(s)
        return 1 if -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= 3.2 and max(map(len, parts)) >= 12 else 0
    if kind in ("phone", "ssn"):
        if before and (before[-1] in _COUNTED or before[-1].isdigit() and not _CODE.search(lead)):
            return 2
        marks = re.sub("[0-9()]", "", s).strip()
        return (1 if s[0] == "(" or len(set(marks)) == 1 else 2) if kind == "phone" else 0
    return 1 if kind == "email" and re.search(r"[(\[]dot[)\]]", s) else 0


def _votes(text: str, kind: str, a: int, b: int, base: bool) -> str:
    s = text[a:b]
    before = re.findall(r"[a-z_0-9]+", text[max(0, a - CONTEXT_CHARS) : a].lower())
    if kind == "email":
        proof = 1 if re.split("[^A-Za-z0-9]+", s.rstrip(")]"))[-1].lower() in _TOP else 0
    elif kind == "card":
        proof = 1 if s[0] in "3456" else 2
    elif kind == "ip":
        proof = 2 if s.startswith("0") else 1
    elif kind == "iban":
        proof = 1 if _iban_ok(s) else 2
    elif kind == "ssn":
        proof = 2 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[-4:] == "0000" else 1
    elif kind == "secret":
        kinds = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        digits = sum(c.isdigit() for c in s) / len(s)
        proof = 1 if len(set(s)) >= 10 and kinds >= 2 and 0.1 <= digits <= 0.9 else 2
    else:
        proof = 1 if 9 <= sum(c.isdigit() for c in s) <= 15 else 0
    near = 1 if _CONTEXT[kind].intersection(before[-4:]) else 0
    against = 2 if _AGAINST.intersection(before[-2:]) else 0
    return f"{1 if base else _form(kind, s, text[max(0, a - 5) : a], before)}{proof}{near}{against}/{_looks(s, before)}"


def _looks(s: str, before: list[str]) -> str:
    """Features of a span: its length as a power of two, its kinds of characters, and the word before it in one of WORD_SLOTS slots."""
    kinds = "".join(c for c, p in zip("aA0-", _KINDS_OF_CHARS, strict=True) if p.search(s))
    return f"{len(s).bit_length()},{kinds},{zlib.crc32(before[-1].encode()) % WORD_SLOTS if before else ''}"


def candidates(text: str | None) -> list[dict]:
    """Base spans and further candidates with their votes; a further one that overlaps a span before it in rank is left out."""
    if not text:
        return []
    if not re.search(r"[0-9@\[(]", text):
        return []
    found = [{"kind": k, "start": a, "end": b, "base": True, "votes": _votes(text, k, a, b, True)} for k, a, b in base_spans(text)]
    taken = _joined([(x["start"], x["end"]) for x in found])
    for kind, shape in _MORE.items():
        new = []
        for m in shape.finditer(text):
            a, b = m.span()
            if kind == "iban" and " " not in m[0] and not _iban_ok(m[0]):
                continue  # it may be a secret
            k = bisect_left(taken, (b,))  # the last taken span that starts before this one ends
            if not k or taken[k - 1][1] <= a:
                new.append((a, b))
                found.append({"kind": kind, "start": a, "end": b, "base": False, "votes": _votes(text, kind, a, b, False)})
        taken = _joined(taken + new)
    return found


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_candidates(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """The column that carries others, and the candidates of each text as an array of structs; a text that is carried is not sent twice."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text") if "text" in batch.schema.names else batch.column(CARRIED).field(text_col)
            found = pa.array([candidates(t) for t in texts(column)], kind)
            yield pa.RecordBatch.from_arrays([batch.column(CARRIED), found], names=[CARRIED, name])

    return text_batches(df).mapInArrow(run, T.StructType([df.schema[CARRIED], T.StructField(name, CANDIDATE, False)]))


def posteriors(votes: np.ndarray, n: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Probability of personal data of each vote pattern of one kind, the log odds of all, and those that each vote of each
    labeler adds, by expectation-maximisation with labelers independent given the class.

    votes: (pattern, labeler); n: candidates with the pattern; base: the share of them that base rules found. Each
    kind has reliabilities of its own; pseudo-counts say that a labeler that speaks is right more often than not and that silence means nothing.
    """
    score = (votes == 1).sum(1) - (votes == 2).sum(1)
    further = n * (1 - base)  # base spans tell how reliable labelers are, not how many further candidates are right
    post = np.clip(0.5 + 0.2 * (score - 1) + 0.2 * base, 0.05, 0.95)
    for _ in range(EM_ROUNDS):
        prior = np.clip(((further * post).sum() + 1) / (further.sum() + 2), 0.02, 0.98)
        log = np.zeros((len(n), 2))
        log[:] = np.log([1 - prior, prior])
        says = np.zeros((LABELERS, 3))
        for j in range(LABELERS):
            sure = base + further / n * post  # base spans are right by their rules
            for c, p in enumerate((1 - sure, sure)):
                seen = np.array([(n * p * (votes[:, j] == x)).sum() for x in range(3)]) + ([5.0, 1.0, 8.0] if c == 0 else [5.0, 5.0, 0.5])
                log[:, c] += np.log(seen / seen.sum())[votes[:, j]]
                says[j] += (1 if c else -1) * np.log(seen / seen.sum())
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return post, float(np.log(prior / (1 - prior))), says


def _features(kind: str, votes: str) -> list[str]:
    voted, looks = votes.split("/")
    length, chars, before = looks.split(",")
    return [f"{kind}", *(f"{kind}:{j}={v}" for j, v in enumerate(voted)), *(f"{j}={v}" for j, v in enumerate(voted)), f"{kind}:length {length}", f"{kind}:chars {chars}", f"{kind}:after {before}", "all"]


def fit(patterns: list[tuple[str, str, bool, int]]) -> dict[str, float]:
    """Probability of personal data for each ``kind:votes/looks``, from (kind, votes/looks, base, count) of all candidates.

    Expectation-maximisation estimates the labelers' reliabilities kind by kind and labels each vote pattern; a
    logistic model on votes and looks is then fitted to these labels. Its penalty draws the weight of a vote to what its
    labeler's reliability says, that of a look to 0, so rare patterns go by the reliabilities.
    """
    if not patterns:
        return {}
    keys = sorted({(k, v) for k, v, _, _ in patterns})
    at = {key: i for i, key in enumerate(keys)}
    n, base, post = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))
    for k, v, b, c in patterns:
        n[at[k, v]] += c
        base[at[k, v]] += c * b
    start: dict[str, float] = {}
    for kind in sorted({k for k, _ in keys}):
        own = np.array([i for i, (k, _) in enumerate(keys) if k == kind])
        voted, to = np.unique([[int(c) for c in keys[i][1].split("/")[0]] for i in own], axis=0, return_inverse=True)
        to = to.ravel()
        m = np.bincount(to, n[own])
        found, odds, says = posteriors(voted, m, np.bincount(to, base[own]) / m)
        post[own] = found[to]
        start |= {kind: odds} | {f"{kind}:{j}={v}": float(says[j, v]) for j in range(LABELERS) for v in range(3)}
    found = [_features(k, v) for k, v in keys]
    names = {f: i for i, f in enumerate(sorted({f for fs in found for f in fs}))}
    x = np.zeros((len(keys), len(names)))
    for i, fs in enumerate(found):
        x[i, [names[f] for f in fs]] = 1
    first = np.array([start.get(f, 0.0) for f in names])
    w, weight = first.copy(), (np.sqrt(n) / np.sqrt(n).sum())[:, None]
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * weight * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + PENALTY / 10 * np.eye(len(w)), (x * weight).T @ (p - post) + PENALTY / 10 * (w - first))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    p = 1 / (1 + np.exp(-x @ w))
    return {f"{k}:{v}": float(q) for (k, v), q in zip(keys, p, strict=True)}


def detect(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, spans_col: str = "pii_spans") -> DataFrame:
    """``keep`` columns with ``spans_col``: array of (kind, start, end, base, votes) by start, then kind as listed.

    Places are code points, ends exclusive. Base spans always stay; a further span stays when the classifier
    gives it MIN_PROBABILITY. A null or empty text has none; repeated rows are each judged alike. Texts are read
    once and never shuffled; only counts of vote patterns are.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    carried = df.select(carry(df, keep), *([] if text_col in keep else [F.col(text_col).alias("text")]))
    found = materialize(find_candidates(carried, text_col, "spans"))
    rows = found.select(F.explode("spans").alias("c")).groupBy("c.kind", "c.votes", "c.base").count().collect()
    chance = fit([(r["kind"], r["votes"], r["base"], r["count"]) for r in rows])
    accepted = F.array(*(F.lit(k) for k, p in sorted(chance.items()) if p >= MIN_PROBABILITY)).cast("array<string>")
    stays = F.filter("spans", lambda c: c["base"] | F.array_contains(accepted, F.concat_ws(":", c["kind"], c["votes"])))
    return unpack(found, keep, **{spans_col: in_order(stays)})


def in_order(spans: Column) -> Column:
    rank = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"])
    keyed = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), rank(c).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))))
    return F.transform(keyed, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """``text_col`` with each span replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    at = df.columns.index(text_col)

    def clean(text: str | None, spans: list[dict]) -> str | None:
        if not text or not spans:
            return text
        out, done = [], 0
        for s in spans:
            if s["start"] >= done:
                out += [text[done : s["start"]], f"<{s['kind'].upper()}>"]
            done = max(done, s["end"])
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([clean(t, s.as_py()) for t, s in zip(texts(batch.column(text_col)), batch.column(spans_col), strict=True)], pa.string())
            yield batch.set_column(at, batch.schema.field(at).name, new)

    return text_batches(df).mapInArrow(run, df.schema)
