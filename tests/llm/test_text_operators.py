"""Text operators against brute force on small corpora, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest

from sessionscope.llm import langid, quality, substring
from sessionscope.llm.decontaminate import find_contamination
from sessionscope.llm.jaccard import keep_first, link_groups
from sessionscope.llm.words import run_hashes, word_hashes

SPACE = re.compile(r"[\x20\x09-\x0D]+")
CLASH = ["g", "okey", "body", "c0", "node", "n_words", "kept", "_linked"]


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=3, n=60):
    """Documents with copies, near copies, shared passages, repeats inside a text, short, empty, null and long texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        kind = i % 10
        own = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))]
        if kind == 1 and texts:
            texts.append(rnd.choice(texts))
            continue
        if kind == 2 and texts:
            own = words(rnd.choice(texts)) or own
            own[rnd.randrange(len(own))] = "changed"
        elif kind == 3:
            own = own[:20] + passage[rnd.randint(0, 30):] + own[20:]
        elif kind == 4:
            own = own * 3
        elif kind == 5:
            own = own[:rnd.randint(1, 6)]
        texts.append(rnd.choice([" ", "\n", "\t ", " \x0b"]).join(own))
    return [*texts, None, "", " \n ", "x" * 30000, " ".join(["same"] * 3000), "one two three four"]


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    """Rows (doc_id, text) with further columns, some of them named like the operators' own."""
    width = len(schema.split(","))
    data = [(*r, *[None] * (width - len(r)), *["clash"] * len(CLASH)) for r in rows]
    return spark.createDataFrame(data, schema + "".join(f", {c} string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def docs():
    texts = corpus()
    rows = [(i * 3 if i % 11 else i * 3 + 1, t) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, texts[7]), (None, texts[12]), (None, None)]


def test_word_hashes_follow_words():
    import pyarrow as pa
    texts = corpus(5)
    hashes, offsets = word_hashes(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True)) and len(set(known.values())) == len(known)
    runs = run_hashes(hashes, 3, 0xD1342543DE82EF95)
    assert len({tuple(flat[i:i + 3]) for i in range(len(runs))}) == len(set(runs.tolist()))


def brute_repeats(rows, length):
    """Removed word places of each distinct document, by the definition."""
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or ""))
    seen, gone = set(), {}
    for key in order:
        w = words(key[1])
        gone[key] = set()
        for i in range(len(w) - length + 1):
            run = tuple(w[i:i + length])
            if run in seen:
                gone[key].update(range(i, i + length))
            seen.add(run)
    return gone


def test_difference_cover():
    shifts = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert shifts == set(range(substring.PERIOD))


@pytest.mark.parametrize("group_bytes", [300, 1 << 20])
def test_substring_dedup(spark, docs, group_bytes):
    rows = [r for r in docs if r[0] is not None]
    got = substring.remove_repeats(frame(spark, rows), group_bytes=group_bytes, bucket_entries=50).collect()
    gone = brute_repeats(rows, 20)
    want = []
    for doc_id, text in rows:
        w = words(text)
        kept = [x for i, x in enumerate(w) if i not in gone[doc_id, text]]
        removed = len(w) - len(kept)
        want.append((doc_id, len(w), removed, hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept) if removed else text))
    assert sorted((tuple(g) for g in got), key=str) == sorted(want, key=str)


def test_substring_dedup_without_ids(spark):
    text = " ".join(f"a{i}" for i in range(25))
    got = substring.remove_repeats(frame(spark, [(None, text), (None, text), (5, text), (None, None)])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in got) == [(False, 25), (True, 0), (True, 0), (True, 0)]  # an id comes after rows without one
    assert substring.remove_repeats(frame(spark, [])).collect() == []


def brute_links(rows, k=5):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = [find(i) for i in range(len(rows))]
    least = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in set(groups)}
    return [(r[0], len(s), least[g]) for r, s, g in zip(rows, sets, groups)], groups


@pytest.mark.parametrize("group_bytes", [400, 1 << 20])
def test_jaccard_join(spark, docs, group_bytes):
    got = link_groups(frame(spark, docs), group_bytes=group_bytes, bucket_entries=200).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute_links(docs)[0], key=str)


def test_jaccard_chain_and_borderline(spark):
    """A chain of texts that link only to their neighbours is one component; 79.9 % does not link."""
    base = [f"t{i}" for i in range(104)]
    chain = []
    for step in range(8):
        w = list(base)
        for j in range(step):
            w[3 + 12 * j] = f"new{j}"
        chain.append(" ".join(w))
    rows = [(10 - i, t) for i, t in enumerate(chain)]
    near = " ".join(["q%d" % i for i in range(13)])
    rows += [(100, near), (101, near + " z")] + [(200, "a b c d e f g h"), (201, "a b c d e f g z")]
    for block in (256, 2):
        got = link_groups(frame(spark, rows), block_classes=block).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(tuple(r) for r in got) == sorted(brute_links(rows)[0])


def test_keep_first(spark, docs):
    rows = [(*r, None, None, i) for i, r in enumerate(docs)]
    kept = keep_first(frame(spark, rows)).collect()
    groups = brute_links(docs)[1]
    assert kept[0].asDict().keys() >= {"doc_id", "text", "n_chars", *CLASH}
    assert sorted({groups[r["n_chars"]] for r in kept}) == sorted(set(groups)) and len(kept) == len(set(groups))
    assert keep_first(frame(spark, [])).collect() == []


ITEMS = [(1, "What is the Capital, of the w1 W2 w3 w4-w5 w6 w7 w8 w9 w10 land?"), (2, "short item"), (None, "secret words here that nobody lists"), (4, None), (5, " .,! "), (2, "short item"),
         (30, "what is the capital of the w1 w2 w3 w4 and more"), (7, "é ü 漢字 x")]


def brute_contamination(rows, items, size=10):
    split = lambda t: re.findall("[0-9a-z\x80-\U0010FFFF]+", lower(t))
    out = []
    for doc_id, text in rows:
        w, hit, found = split(text), set(), set()
        for item_id, item in items:
            x = split(item)
            n = min(size, len(x))
            for i in range(len(x) - n + 1 if x else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == x[i:i + n]:
                        hit.update(range(j, j + n))
                        if item_id is not None:
                            found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, block_bytes):
    rows = [*docs, (1000, "so: WHAT is the capital of the W1 w2 w3 w4 w5 w6 w7 w8 w9 w10 land, and a short item!"), (1001, "short... item short-item short"), (1002, "É ü 漢字 x é ü 漢字 X"),
            (1003, "Secret words here that nobody lists")]
    bench = frame(spark, ITEMS, "item_id long, text string")
    got = find_contamination(frame(spark, rows), bench, block_bytes=block_bytes)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted(brute_contamination(rows, ITEMS), key=str)
    text = dict(rows)[1000]
    hits = got.where("doc_id = 1000").first()["hits"]
    assert [text[h["start_char"]:h["end_char"]] for h in hits] == [text[4:text.index("land") + 4], "short item"]


def test_decontamination_of_nothing(spark, docs):
    bench = frame(spark, [], "item_id long, text string")
    assert not any(r["contaminated"] for r in find_contamination(frame(spark, docs), bench).collect())
    assert find_contamination(frame(spark, []), bench).collect() == []


def brute_quality(text):
    w = words(text)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeated = {p for v in where.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_and_verdict(spark, docs):
    clean = " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    junk = [" ".join(w + "***" for w in words(clean)), clean.upper(), " ".join(w + "!!" for w in words(clean)), "\n".join([clean[:60]] * 9 + [clean]), " ".join(map(str, range(90)))]
    rows = [*docs, (5000, clean), (5001, clean + "\n" + clean[:40]), *[(6000 + i, t) for i, t in enumerate(junk)], (7000, "a b c a b c a b c \n a # <b>|")]
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(frame(spark, rows)).collect()}
    want = set()
    for doc_id, text in rows:
        counts = brute_quality(text)
        want.add((doc_id, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]))
    assert got == want
    verdict = {r["doc_id"]: (r["kept"], r["failed_rule"]) for r in quality.judge(frame(spark, rows[len(docs):])).collect()}
    assert verdict[5000] == (True, None) and verdict[5001][0] and not any(verdict[6000 + i][0] for i in range(len(junk)))
    assert quality.judge(frame(spark, [])).collect() == []


def test_quality_filter_on_verdict_stays_linear(spark):
    """A filter on the result is pushed under the projections; it must not repeat an array once an element."""
    rows = [(i, " ".join(f"w{j % 997}" for j in range(20000))) for i in range(4)]
    assert quality.judge(frame(spark, rows)).where("kept").count() == 0


def test_rule_order(spark):
    sample = spark.range(2000).selectExpr("id", "repeat('x ', 40) as body")
    from pyspark.sql import functions as F
    order = quality.estimate_order(sample, {"never": F.col("id") < 0, "often": F.col("id") % 2 == 0})
    assert [o[0] for o in order][0] == "often" and order[0][1] == 0.5 and all(o[2] > 0 for o in order)


LANGS = {"aa": "the cat sat on the mat and saw what was there with them", "bb": "der hund und die katze ist nicht auf dem tisch", "cc": "el perro y la casa que no es para los gatos"}


def language_rows(n=240):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        rows.append((i, " ".join(rnd.choices(LANGS[lang].split(), k=rnd.randint(4, 60))), lang))
    return rows


def test_language_id(spark):
    mixed = " ".join(LANGS["aa"].split() * 30 + LANGS["bb"].split() * 60)
    rows = [*language_rows(), (900, None, "aa"), (901, "", "aa"), (902, " 12 -- 34 ", None), (903, mixed, None), (None, LANGS["cc"] * 3, None), (904, "x" * 50000, None), (904, "x" * 50000, None)]
    table = frame(spark, rows)
    model = langid.train(table)
    assert model[0] == ["aa", "bb", "cc"] and np.allclose(model[1].sum(0), 1)
    found = langid.identify(table, model).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[903]["lang_pred"] == "bb" and [x["lang"] for x in by_id[903]["languages"]] == ["bb", "aa"] and 0.5 < by_id[903]["score"] < 0.8
    assert by_id[None]["lang_pred"] == "cc" and all(0 <= r["score"] <= 1 for r in found)
    import zlib
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 40 and sum(by_id[r[0]]["lang_pred"] == r[2] for r in held) >= 0.98 * len(held)


def test_language_id_learns_nothing_from_held_out(spark):
    import zlib
    rows = [(i, "only here", "zz") for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert langid.train(frame(spark, rows))[0] == [] and langid.train(frame(spark, []))[0] == []
    assert {r["lang_pred"] for r in langid.identify(frame(spark, rows), langid.train(frame(spark, rows))).collect()} == {"und"}


def test_em_proportions():
    p = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]])
    counts = 1000 * (p @ np.array([0.3, 0.7]))
    pi, _ = langid.proportions(p, counts, np.array([0.5, 0.5]))
    assert np.allclose(pi, [0.3, 0.7], atol=0.02)
