"""Operators 11 to 13 against their libraries and plain brute force, with edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import struct
import zlib

import pytest

tiktoken = pytest.importorskip("tiktoken")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from fathomline.llm import byte_bpe, conversation_repair, queries, token_alignment  # noqa: E402

RANKS, JSON, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
BITS = ["a", "e", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "漢字", "😀", "\x00", "<|endoftext|>", "</s>", "'s", "'ll", "1", "2024", "_", "--", "▁", "́", " ", "\x1c", "zq"]


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def odd_texts(n: int = 150) -> list[str | None]:
    rng = random.Random(3)
    return [None, "", " ", "\n\n", "x" * 3000, "ab " * 2000, "\n" * 300, *("".join(rng.choice(BITS) for _ in range(rng.randint(1, 60))) for _ in range(n)), "the the", "the the", None]


@pytest.fixture(scope="module")
def table(spark):
    """Repeated rows, nulls, and columns whose names clash with results."""
    return spark.createDataFrame([(i if i != 5 else None, t, "x", 7) for i, t in enumerate(odd_texts())], "doc_id bigint, text string, token_ids string, n_links int")


def saved(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


# 12 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rank_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_query(spark, table, tmp_path, rank_encoding):
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_byte_bpe(spark, saved(table, tmp_path)).collect())
    want = []
    for t in odd_texts():
        ids = rank_encoding.encode_ordinary(t or "")
        want.append((len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())))
    assert got == sorted(want)


def test_byte_bpe_columns_and_decode(spark, table, rank_encoding):
    out = byte_bpe.encode(table, RANKS, P.PATTERN, decoded_col="n_links")
    assert out.columns == ["doc_id", "text", "token_ids", "n_links", "token_ids_", "n_links_"]
    for r in byte_bpe.decode(out.drop("n_links_"), RANKS, P.PATTERN, ids_col="token_ids_").collect():
        assert r["token_ids_"] == rank_encoding.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    packed = byte_bpe.encode(table, RANKS, P.PATTERN, packed=True, keep=["text"])
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in byte_bpe.decode(packed, RANKS, P.PATTERN).collect())
    assert byte_bpe.encode(table.limit(0), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_model(rank_encoding, monkeypatch):
    m = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    assert all(m.pieces.encode(t.decode("latin-1").translate(m.alphabet)) == [i] for i, t in enumerate(m.tokens))
    monkeypatch.setattr(byte_bpe, "MEMORY", 5)  # both generations turn over again and again
    unpack = lambda x: list(struct.unpack(f"<{len(x) // 4}I", x))
    for t in odd_texts(400):
        assert unpack(m.encode(t or "")) == rank_encoding.encode_ordinary(t or "")
    long = "".join(random.Random(1).choices("abcdefgh", k=100_000))
    assert unpack(m.encode(long)) == rank_encoding.encode_ordinary(long)


def test_pre_tokens_of_every_code_point(rank_encoding):
    m = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    for c in [*range(0xD800), *range(0xE000, 0x110000, 7)]:
        s = f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}  x"
        assert m.decode(m.encode(s)) == s.encode()
        if c < 0x3100 or c % 64 == 0:
            assert [x for x, in struct.iter_unpack("<I", m.encode(s))] == rank_encoding.encode_ordinary(s)


# 13 -----------------------------------------------------------------------------------------------------------------


def aligned_by_hand(docs):
    """Each text's figures by the plain definition, with the libraries."""
    a_lib = tokenizers.Tokenizer.from_file(JSON)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    back = {c: b for b, c in enumerate(byte_bpe.byte_characters())}
    of_a = lambda i: bytes(back[c] for c in a_lib.id_to_token(i))

    def of_b(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], collections.Counter()
    for t in docs:
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        x, y = [of_a(i) for i in a], [of_b(i) for i in b]
        if b"".join(x) != b"".join(y) or b"".join(x) != (" " + (t or "")).encode():
            a, b, x, y = [], [], [], []
        groups, i, j, at_i, at_j = [], 0, 0, 0, 0
        size_i = size_j = 0
        while i < len(a) or j < len(b):
            if size_i <= size_j:
                size_i, i = size_i + len(x[i]), i + 1
            else:
                size_j, j = size_j + len(y[j]), j + 1
            if size_i == size_j:
                groups.append((a[at_i:i], b[at_j:j]))
                at_i, at_j = i, j
        links = [(p, q) for g, h in groups for p in g for q in h]
        counts.update(set(links))
        found.append((a, b, groups, links))
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for a, b, groups, links in found:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), text))
    return out


@pytest.mark.parametrize("frequent", [100_000, 3, 0])
def test_alignment_query(spark, table, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    got = queries.op13_token_alignment(spark, saved(table, tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(*x[:6], sha(x[6]) if x[0] else "") for x in aligned_by_hand(odd_texts())]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(want)
    assert any(x[0] for x in want) and sum(not x[0] for x in want) >= 5


def test_alignment_columns(spark, table, monkeypatch):
    monkeypatch.setattr(token_alignment, "WIDE", 4)  # in this process only; workers keep the default
    out = token_alignment.align(table, JSON, P.PATTERN, PIECES)
    assert out.columns == ["doc_id", "token_ids", "n_links", "n_a", "n_b", "n_groups", "n_links_", "n_best", "count_sum", "groups"]
    assert sorted(r["groups"] for r in out.collect()) == sorted(x[6] for x in aligned_by_hand(odd_texts()))
    assert token_alignment.align(table.limit(0), JSON, P.PATTERN, PIECES).count() == 0


def test_wide_groups_and_long_texts(monkeypatch):
    m = token_alignment.Aligner(JSON, P.PATTERN, PIECES)
    for t in odd_texts():
        a, b = m.tokens(t)
        cuts = m.cuts(a, b)
        plain = [x.tolist() for x in m.links(a, b, *cuts)]
        monkeypatch.setattr(token_alignment, "WIDE", 1)
        assert plain == [x.tolist() for x in m.links(a, b, *cuts)]
        monkeypatch.setattr(token_alignment, "WIDE", 4_096)
        monkeypatch.setattr(token_alignment, "LIBRARY_TEXT", 3)
        assert [x.tolist() for x in m.tokens(t)] == [a.tolist(), b.tolist()]
        monkeypatch.setattr(token_alignment, "LIBRARY_TEXT", 1_000_000)


# 11 -----------------------------------------------------------------------------------------------------------------

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def repaired_by_hand(rows):
    """All figures of the rows of one conversation, by dynamic programming over its prefixes that keeps the whole edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    n = collections.Counter()
    seen, best = set(), {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for s, (c, e, t) in list(out.items()):
                x = (c + 3, e + "I", (*t, {"u": "user:", "a": "assistant:"}[NEXT[s]]))
                if x < out.get(NEXT[s], (1 << 40,)):
                    out[NEXT[s]] = x
        return out

    for k, (_, role, text) in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        n[fault] += 1
        n["illegal"] += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        new = {}
        for s, (c, e, t) in inserted(best).items():
            options = [(s, (c + 4, e + "D", t))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if (s, role[:1]) in AFTER:
                    options.append((AFTER[s, role[:1]], (c + more, e + "K", (*t, f"{role}:{text}"))))
                options.append((NEXT[s], (c + 3 + more, e + "R", (*t, {"u": "user:", "a": "assistant:"}[NEXT[s]] + text))))
            for after, x in options:
                new[after] = min(x, new.get(after, x))
        best = new
    c, e, t = min(v for s, v in inserted(best).items() if s in ("", "a"))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], c, e, sha("\n".join(t))


def conversations(seed=4, n=120):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        for turn in range(rng.choice([1, 2, 5, 9, 40])):
            text = rng.choice(["Yes.", "No!", "", " \t", "cut off", "Who?", "done.\n ", None, "ok. then", "\x0b"])
            out.append((k if k else None, rng.choice([turn, turn, turn, turn + 3, turn // 2, None, -turn]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "aide"]), text if rng.random() < 0.6 else f"{text} {turn}."))
    out += rng.sample(out, 20)
    return out


def grouped(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return out


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("long", [4096, 6])
def test_repair(spark, monkeypatch, long):
    monkeypatch.setattr(conversation_repair, "LONG", long)
    df = spark.createDataFrame(conversations(), "audit bigint, turn bigint, role string, text string").repartition(5)
    out = conversation_repair.repair(df, conv_col="audit", with_text=True)
    assert out.columns == ["audit_", *FIGURES, "repaired_text"]
    got = {r[0]: tuple(r)[1:9] for r in out.collect()}
    assert got == {k: repaired_by_hand(v) for k, v in grouped(conversations()).items()}
    assert all(sha(r["repaired_text"]) == r["repaired_sha256"] and re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in r["repaired_text"].split("\n") if re.match("[a-z]+:", t))) for r in out.where("repaired_text not like '%\n%'").collect())


def test_damaged_query(spark, tmp_path):
    rows = conversations(7) + [(99_000 + k, k, "user", "Hm.") for k in range(60)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op11_conversation_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", *FIGURES]
    hurt = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        row = (turn, "user" if x == 4 else role, "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text)
        hurt[conv] += [row] * (0 if x == 0 else 2 if x == 3 else 1)
    empty = (0, 0, 0, 0, 0, 0, "", sha(""))
    want = {k: repaired_by_hand(v) if v else empty for k, v in hurt.items()}
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
    assert empty in want.values()


def test_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "LONG", 100)
    rng = random.Random(2)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"so {k}.", f"cut {k}", ""])) for k in range(3000)] + [(1, None, "user", "again.")] * 500
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    (got,) = conversation_repair.repair(df).collect()
    assert tuple(got)[1:] == repaired_by_hand([r[1:] for r in rows])


def test_repair_edge_cases(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert conversation_repair.repair(spark.createDataFrame([], schema)).count() == 0
    far = spark.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], schema)
    assert conversation_repair.repair(far).first()["gaps"] == (1 << 63) - 1


def test_auction_against_all_kinds():
    import itertools

    role = {"x": "user", "s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(4):
        for kinds in itertools.product("xsuaoSUAO", repeat=n):
            rows = [(k, role[c.lower()], " " if c == "x" else f"{k}" + ("" if c.isupper() else ".")) for k, c in enumerate(kinds)]
            letters, state = conversation_repair.cheapest("".join(kinds))
            letters += ("", "II", "I", "")[state]
            want = repaired_by_hand(rows)
            assert (conversation_repair.cost_of("".join(kinds), letters), letters) == (want[5], want[6])
