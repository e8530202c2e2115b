"""Byte-pair encoding, conversation prefixes and importance resampling against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sessionscope.llm import bytepair, prefixtrie, resample
from sessionscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return bytepair.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=60, seed=5):
    rnd = random.Random(seed)
    texts = ["", " ", "\n\n", "a", "don't we'll", "x" * 5000, " " * 700 + "end", "é" * 333, "<|endoftext|>", "漢字かな　 \u0085x", "\x00\x1c\x1f"]
    for _ in range(n):
        texts.append("".join(rnd.choice("etaoin shrdlu\n\t'12éß漢😀.,!?") for _ in range(rnd.randint(1, 400))) + rnd.choice("abc") * rnd.randint(0, 130))
    return texts


def expected_tokens(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_encode_equals_the_library(spark, vocabulary, library):
    texts = [None, *odd_texts()]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], None), (None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bytepair.decode(bytepair.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary).collect()
    assert len(out) == len(rows)
    by_id = dict((r[0], r[1]) for r in rows)
    for r in out:
        text = by_id[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_a_text_longer_than_a_block(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(bytepair, "BLOCK_BYTES", 64)
    monkeypatch.setattr(bytepair, "REMEMBERED", 10)
    rows = list(enumerate(["one two  three " * 50, *odd_texts(20)]))
    out = bytepair.encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out} == {i: library.encode_ordinary(t) for i, t in rows}


def test_short_and_long_pieces_merge_alike(vocabulary):
    encoder = bytepair._Encoder(vocabulary)
    merges = dict(zip(vocabulary.pairs.tolist(), vocabulary.merged.tolist(), strict=True))
    rnd = random.Random(2)
    pieces = [bytes(rnd.choice(b"etaoinsx") for _ in range(rnd.randint(1, bytepair.SHORT))) for _ in range(500)]
    assert bytepair.merge_short(pieces, encoder.first, vocabulary.pairs, vocabulary.merged) == [bytepair.merge_long(p, encoder.first, merges) for p in pieces]
    assert bytepair.merge_short([], encoder.first, vocabulary.pairs, vocabulary.merged) == []


def test_carried_columns_and_empty_tables(spark, vocabulary):
    docs = spark.createDataFrame([("t", 1, None, b"z")], "body string, c0 int, text string, decoded binary")
    out = bytepair.decode(bytepair.encode(docs, vocabulary, public_tokenizers.PATTERN, "body", ("c0", "decoded", "body")), vocabulary)
    assert out.columns == ["c0", "body", "ids", "decoded"]
    assert [(r["c0"], r["body"], bytes(r["decoded"])) for r in out.collect()] == [(1, "t", b"t")]
    none = bytepair.decode(bytepair.encode(docs.limit(0), vocabulary, public_tokenizers.PATTERN, "body", ()), vocabulary)
    assert none.collect() == []


def test_a_vocabulary_without_a_byte(spark, tmp_path):
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([b"a", b"b", b"ab"])))
    small = bytepair.load_vocabulary(str(tmp_path / "ranks"))
    encoder = bytepair._Encoder(small)
    encoder.learn(["ab", "aab", "ba"])
    assert [np.frombuffer(encoder.known[x], "<u4").tolist() for x in ("ab", "aab", "ba")] == [[2], [0, 2], [1, 0]]
    with pytest.raises(ValueError, match="lacks a byte"):
        encoder.learn(["abc"])


def test_registered_encoding_of_whole_documents(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op11_segment_tree_bpe"][0](spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out} == {i: expected_tokens(library, t) for i, t in texts.items()}


def brute_trie(members):
    """Rows of every prefix, from the whole sequences of turns by conversation."""
    nodes = {}
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    rows = []
    for path, convs in nodes.items():
        subtree = [p for p in nodes if p[:len(path)] == path]
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[:len(path)] == path]
        leaves = sum(not any(q[:len(p)] == p and len(q) > len(p) for q in subtree) for p in subtree)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in subtree if p)
        ends = ",".join(str(c) for c in sorted(convs) if members[c] == path)
        rows.append((min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def turns_of(rows):
    ids = {r[0] for r in rows if r[0] is not None}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return {c: tuple((r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)) for c in ids}


def conversation_rows(n, seed):
    """Copies, shared openings, prefixes of others, one long conversation, ties, nulls and repeated rows."""
    rnd = random.Random(seed)
    rows = []
    for c in range(0, 3 * n, 3):
        turns = [("user" if k % 2 == 0 else "assistant", rnd.choice("abc") * rnd.randint(1, 2)) for k in range(rnd.randint(1, 6))]
        if c % 4 == 0:
            turns = [("user", "hot"), ("assistant", "same")]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(3 * n, k, "user", "abé😀"[k % 4]) for k in range(300)] + [(3 * n + 1, k, "user", "abé😀"[k % 4]) for k in range(120)]
    rows += [(-7, None, "user", "x"), (-7, None, "user", "x"), (-7, 1, None, None), (-7, 1, "user", "b"), (-7, 1, "user", "a"), (None, 0, "user", "lost"), (-9, 2, None, ""), (100, 5, "user", "late")]
    return rows


def trie_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_prefix_nodes_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(prefixtrie, "CHUNK", 20)
    monkeypatch.setattr(prefixtrie, "BLOCK_BYTES", 2000 if block_bytes == 1 else block_bytes)
    rows = conversation_rows(70, 4)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    members = turns_of(rows)
    found = prefixtrie.prefix_nodes(prefixtrie.turn_sequences(frame.repartition(3)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert trie_rows(found) == brute_trie(members)


def test_prefix_runs_by_search_on_random_sequences():
    rnd = random.Random(8)
    turn = lambda k: bytes([k]) * 16 + (k + 1).to_bytes(4, "big")
    for _ in range(60):
        paths = sorted({tuple(rnd.randrange(2) for _ in range(rnd.randint(0, 5))) for _ in range(rnd.randint(1, 20))})
        p = prefixtrie._Sorted([b"".join(map(turn, x)) for x in paths]).prefixes()
        expected = sorted({x[:d] for x in paths for d in range(len(x) + 1)})
        assert [paths[r][:d] for r, d in zip(p.row, p.depth, strict=True)] == expected
        for k, x in enumerate(expected):
            run = [i for i, y in enumerate(paths) if y[:len(x)] == x]
            assert (p.row[k], p.right[k]) == (run[0], run[-1])
            assert p.end[k] == k + sum(y[:len(x)] == x for y in expected)
            assert p.parent[k] == (expected.index(x[:-1]) if x else -1)
            assert p.chars[k] == (x[-1] + 1 if x else 0)


def rebuilt(members):
    out = {}
    for c, turns in members.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = members.get(c - c % 100, ())[:h] + turns[h:]
    return out


def test_registered_trie_with_rebuilt_conversations(spark, tmp_path):
    rows = [r for r in conversation_rows(90, 6) if r[0] is None or r[0] >= 0]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert trie_rows(QUERIES["op12_prefix_trie"][0](spark, str(tmp_path))) == brute_trie(rebuilt(turns_of(rows)))


def test_trie_of_nothing_and_of_turnless_conversations(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_nodes(prefixtrie.turn_sequences(empty)).collect() == []
    one = spark.createDataFrame([(5, b""), (3, b"")], "conv long, seq binary")
    assert trie_rows(prefixtrie.prefix_nodes(one)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def brute_resample(rows, target, least, percent, buckets=10000, longest=1):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(runs(words(text)))
    for text in target:
        t.update(runs(words(text)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in rows:
        found, h = runs(words(text)), int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text)) >= least])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    place = {id(r): k + 1 for k, r in enumerate(drawn[:len(drawn) * percent // 100])}
    return sorted([(*r[:4], place.get(id(r))) for r in out], key=str)


def resample_rows(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(50)]
    rows = [(i, rnd.choice([" ", "\n", "-", "_."]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " .,"), (n + 3, "long " * 9000), (None, "same words " * 15), (7, rows[7][1]), (7, rows[7][1]), (-5, "w1 " * 30)]
    return rows, ["w1 w2 w3 w4", None, "", "W5é " * 40]


@pytest.mark.parametrize(("percent", "longest", "parts"), [(10, 1, 3), (100, 1, 7), (55, 3, 1), (0, 1, 2)])
def test_resampling_against_brute_force(spark, monkeypatch, percent, longest, parts):
    monkeypatch.setattr(resample, "BLOCK_BYTES", 100)
    monkeypatch.setattr(resample, "RUN_ROWS", 25)
    rows, target = resample_rows(300, 3)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _s string, score int").repartition(parts)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.resample(docs, items, carry=("_s",), longest=longest, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank", "_s"]
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == brute_resample(rows, target, 20, percent, longest=longest)


def test_one_score_for_all_rows(spark, monkeypatch):
    """A single hot key of the sort: segments are cut by the tie."""
    monkeypatch.setattr(resample, "RUN_ROWS", 10)
    rows = spark.range(500).selectExpr("5L as score", "id as doc_id").repartition(6)
    ranked = resample.rank_highest(rows, "score", "doc_id", 500, 480).collect()
    assert sorted((r["doc_id"], r["rank"]) for r in ranked if r["rank"]) == [(i, i + 1) for i in range(480)]
    assert len(ranked) == 500


def test_resampling_of_nothing(spark):
    empty, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resample(empty, items).collect() == []
    one = spark.createDataFrame([(1, "w " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in resample.resample(one, items, percent=100).collect()] == [1]
