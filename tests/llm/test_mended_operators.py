"""Cases that earlier versions of the operators lost, refused or put into one task."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sessionscope.llm import langid, mixing, preference, urllists
from sessionscope.llm.jaccard import keep_first, link_groups


def test_every_conversation_and_turn_is_paired(spark):
    """Rejected sides diverge at any assistant turn and may end there; nothing of the chosen side is lost."""
    rows = [(c, k, ("user", "assistant")[k % 2], f"text {c} {k}") for c in range(60) for k in range(c % 9 + 1)] + [(70, 0, "system", None), (71, None, None, "x"), (None, 0, "user", "lost")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chosen, rejected = preference.pairs_from_conversations(table)
    left = {}
    for r in rejected.collect():
        left.setdefault(r["pair_id"], []).append((r["turn"], r["role"], r["text"]))
    assert sorted(map(tuple, chosen.collect()), key=str) == sorted((r for r in rows if r[0] is not None), key=str)
    early = shorter = 0
    for c in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r[1:] for r in rows if r[0] == c), key=lambda t: (t[0] is not None, t[0] or 0))
        answers = [i for i, t in enumerate(own) if t[1] == "assistant"]
        number = int(hashlib.md5(str(c).encode()).hexdigest()[:7], 16)
        want = own
        if answers:
            at = answers[number % len(answers)]
            want = own[:at] + [(*own[at][:2], own[0][2])] + ([] if number // 16 % 2 else own[at + 1:])
            early += at < answers[-1]
            shorter += len(want) < len(own)
        assert sorted(left[c], key=str) == sorted(want, key=str)
    assert early > 5 and shorter > 5
    out = preference.format_pairs(chosen, rejected).withColumn("mask", preference.mask(F.col("chosen_segments"))).collect()
    assert len(out) == 62 and sum(not r["usable"] for r in out) >= 8
    for r in out:
        lengths = [int(x[1:]) for x in r["mask"].split(",")] if r["mask"] else []
        assert sum(lengths) == len(r["chosen"]) and [x[0] == "t" for x in r["mask"].split(",") if x] == [s["trained"] for s in r["chosen_segments"]]
    assert any("m" in r["mask"] for r in out)


def test_columns_of_any_name_pass_through(spark):
    names = ["doc_id", "text", "source", "_mix_key", "_mix_n", "a.b", "mean", "key", "c0", "shuffle_key"]
    rows = [(i, f"words of text number {i % 3} that are the same", "s", f"k{i}", i, "dot", 1.5, "x", "y", 9) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k string, n int, d string, m double, key string, c string, s long").toDF(*names)
    mixed = mixing.mix(docs, size=3.0)
    assert mixed.columns == [*names[:-1], "copy", "shuffle_key"]
    by_id = {r[0]: r for r in rows}
    got = mixed.collect()
    assert got and all(tuple(r)[:9] == by_id[r["doc_id"]][:9] for r in got)
    kept = keep_first(docs)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == rows[:3]


def test_a_mean_of_any_size_is_drawn(spark):
    docs = spark.createDataFrame([(1, "ab", "b"), (2, "c" * 4000, "a")], "doc_id long, text string, source string")
    copies = mixing.mix(docs, {"b": 1.0}, size=1.0).groupBy("doc_id").count().collect()
    assert [r["doc_id"] for r in copies] == [1] and 1700 < copies[0]["count"] < 2300
    with pytest.raises(ValueError, match="repeated"):
        mixing.mix(docs, {"b": 1.0}, max_mean=500)


def test_more_languages_than_a_dense_model_could_hold(spark):
    texts = {f"l{i:04d}": " ".join(chr(0x4E00 + (i * 7 + j) % 5000) * 2 for j in range(12)) for i in range(1101)}
    rows = [(i * 100 + k, text, lang) for i, (lang, text) in enumerate(texts.items()) for k in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = langid.train(table)
    assert len(langs) > 1000 and model.shape == (1 << langid.BITS, len(langs))
    found = langid.identify(table.where("doc_id % 100 = 0").limit(40), (langs, model)).collect()
    right = {r[0]: r[2] for r in rows}
    assert sum(r["lang_pred"] == right[r["doc_id"]] for r in found) >= 0.7 * len(found)


def test_only_keys_of_the_list_reach_the_join(spark, monkeypatch):
    captures = spark.createDataFrame([(i, f"http://h{i % 40}.example{i % 3}.com/{i}", "2024-03-05") for i in range(300)], "page_id long, url string, day string").withColumn("fetched", F.to_date("day"))
    entries = spark.createDataFrame([("example1.com", "block", "2024-01-01"), ("h3.example0.com", "allow", "2024-01-01"), ("org", "block", "2024-01-01")], "pattern string, action string, day string").withColumn("dated", F.to_date("day"))
    decided = {}
    for limit in (urllists.BROADCAST_BYTES, 0):
        monkeypatch.setattr(urllists, "BROADCAST_BYTES", limit)
        out = urllists.evaluate(captures, entries)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("LeftSemi" in plan) == (limit > 0) and "Window" not in plan
        decided[limit] = sorted(map(tuple, out.collect()))
    assert decided[0] == decided[urllists.BROADCAST_BYTES or 0] == next(iter(decided.values()))
    assert sum(r[3] == "block" for r in decided[0]) == 100


def test_rows_without_a_set_meet_in_no_reducer(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else " ") for i in range(200)] + [(500, "a b c d e f g"), (501, "a b c d e f g")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["linked"]) for r in link_groups(docs).collect()}
    assert len(found) == 202 and found[500] == found[501] == (3, 500, True)
    assert all(found[i] == (0, i, False) for i in range(200))


def test_long_items_repeated_items_and_many_blocks(spark, monkeypatch):
    """A long item is cut; repeats of an item are one; several blocks find what one finds."""
    from sessionscope.llm import decontaminate
    long = " ".join(f"w{i}" for i in range(3000))
    bench = spark.createDataFrame([(1, long), (1, long), (2, "a short one"), (3, "Ten Words of a benchmark question that is long enough here"), (None, "no id but words")] * 3, "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(200 * i, 200 * i + 9 + i)) + " x " + ("A short ONE" if i % 3 == 0 else "no id but words")) for i in range(12)] + [(50, None), (51, long)], "doc_id long, text string")
    whole = sorted((tuple(r) for r in decontaminate.find_contamination(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 64)
    pieces = decontaminate.item_pieces(bench, 10, "item_id", "text").collect()
    assert max(len(r["body"].split()) for r in pieces) <= 64 and len(pieces) == len({tuple(r) for r in pieces}) > 50
    for block_bytes in (1 << 20, 3000):
        assert sorted((tuple(r) for r in decontaminate.find_contamination(docs, bench, block_bytes=block_bytes).collect()), key=str) == whole
    assert sum(r[5] for r in whole) >= 12 and [r[2] for r in whole if r[0] == 51] == [3000]


def test_an_item_of_more_words_than_symbols(spark):
    from sessionscope.llm import decontaminate
    text = " ".join(f"{i:x}" for i in range(1_200_000))
    docs = spark.createDataFrame([(1, " ".join(f"{i:x}" for i in range(700_000, 700_030)))], "doc_id long, text string")
    pieces = decontaminate.item_pieces(spark.createDataFrame([(9, text)], "item_id long, text string"), 10, "item_id", "text")
    assert pieces.count() == -(-(1_200_000 - 9) // (decontaminate.PIECE_WORDS - 9))
    some = pieces.where(F.col("body").contains(" aae60 "))
    found = decontaminate.find_contamination(docs, some, item_id="item", item_text="body").collect()
    assert (found[0]["n_hit"], found[0]["n_items"]) == (30, 1)


def test_recorded_headers_and_digests_are_kept(spark):
    from sessionscope.llm import warc
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-IP-Address: 192.0.2.7\r\nWARC-Truncated: length\r\nWARC-Payload-Digest: sha256:abc\r\nno header\r\n"
    rows = [("<urn:a>", "response", "http://x.example/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>text</p>", head), ("<urn:b>", "response", None, None, "plain", None), ("<urn:c>", "request", None, None, "x", head)]
    records = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, warc_date string, block string, head string")
    out = {(r["refers_to"], r["record_type"]): r for r in warc.build_derivatives(records, recorded="head").collect()}
    assert len(out) == 4
    for kind in ("metadata", "conversion"):
        assert out["<urn:a>", kind]["source_payload_digest"] == "sha256:abc" and out["<urn:a>", kind]["source_block_digest"] == warc.digest(rows[0][4].encode())
        assert out["<urn:b>", kind]["source_payload_digest"] == warc.digest(b"plain")
    body = out["<urn:a>", "metadata"]["block"]
    assert all(x in body for x in ("sourceRecord-WARC-IP-Address: 192.0.2.7\r\n", "sourceRecord-WARC-Truncated: length\r\n", "sourcePayloadDigest: sha256:abc\r\n", "sourceHeader-A: b\r\n"))
    assert "sourceRecord" not in out["<urn:b>", "metadata"]["block"]
    assert {r["record_id"] for r in warc.build_derivatives(records).collect()} == {r["record_id"] for r in out.values()}
