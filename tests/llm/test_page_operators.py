"""Page, conversation, mixing and list operators on small inputs, with nulls, repeats, empty tables and clashing columns."""

import base64
import datetime
import glob
import gzip
import hashlib
import math
import random

import numpy as np
import pytest

from sessionscope.llm import boilerplate, mixing, preference, urllists, warc
from sessionscope.llm.markup import CHROME, CONTENT, PLAIN, blocks

CLASH = ["c0", "host", "page", "part", "key", "pair", "side", "t", "mean", "copy", "best"]


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], schema + "".join(f", {c} string" for c in CLASH)).repartition(3)


# --- preference formatting -------------------------------------------------------------------------------------------

def turns(spark, rows):
    return frame(spark, rows, "pair_id long, turn long, role string, text string")


def test_preference_pairs(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "good"), (2, 0, "user", "same"), (3, 1, "assistant", "b"), (3, 0, None, "a"),
              (None, 0, "user", "lost"), (4, 0, "user", "x"), (4, 0, "user", "x"), (4, 1, "assistant", "long" * 20000), (6, 0, "user", "only chosen")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "bad"), (2, 0, "user", "same"), (3, 0, None, "a"), (3, 1, "assistant", "c"), (4, 0, "user", "x")]
    got = {r["pair_id"]: r for r in preference.format_pairs(turns(spark, chosen), turns(spark, rejected)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6]
    one = got[1]
    assert (one["n_prompt_turns"], one["prompt"]) == (3, "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n")
    assert (one["chosen"], one["rejected"], one["usable"]) == ("<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad<|end|>\n", True)
    assert [tuple(s) for s in one["chosen_segments"]] == [("<|assistant|>\ngood<|end|>\n", True)] and one["chosen_trained_chars"] == len(one["chosen"])
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"], got[2]["usable"]) == (1, "", "", False)
    assert got[3]["n_prompt_turns"] == 1 and got[3]["prompt"] == "<||>\na<|end|>\n" and got[3]["usable"]
    assert got[4]["n_prompt_turns"] == 1 and [s["trained"] for s in got[4]["chosen_segments"]] == [False, True] and got[4]["rejected"] == "" and len(got[4]["chosen"]) > 80000
    assert got[6]["n_prompt_turns"] == 0 and got[6]["prompt"] == "" and got[6]["rejected"] == ""
    assert preference.format_pairs(turns(spark, []), turns(spark, [])).collect() == []


# --- WARC ------------------------------------------------------------------------------------------------------------

def records(spark, rows):
    return frame(spark, rows, "record_id string, record_type string, target_uri string, warc_date string, block string")


HTML = "<html><head><title>T &amp; t</title></head><body><p>Hello&nbsp;<b>w</b>orld</p><a href='/x?a=1&amp;b=2'>link é</a></body></html>"


def test_warc_round_trip(spark, tmp_path):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Odd: a: b\r\n\r\n{HTML}"
    rows = [("<urn:uuid:1>", "response", "http://a/", "2024-01-01T00:00:00Z", block), ("<urn:uuid:2>", "request", "http://a/", None, block), (None, "response", None, None, block),
            ("<urn:uuid:3>", "response", None, None, None), ("<urn:uuid:4>", None, None, None, block), ("<urn:uuid:5>", "response", "http://b/", None, "no head\r\n\r\nat all")]
    derived = warc.build_derivatives(records(spark, rows))
    got = {(r["refers_to"], r["record_type"]): r for r in derived.collect()}
    assert sorted({k[0] for k in got}) == ["<urn:uuid:1>", "<urn:uuid:3>", "<urn:uuid:5>"] and len(got) == 6
    text, meta = got["<urn:uuid:1>", "conversion"], got["<urn:uuid:1>", "metadata"]
    assert text["block"] == "Hello world\nlink é" and text["target_uri"] == "http://a/" and f"WARC-Refers-To: <urn:uuid:1>\r\n" in text["headers"]
    assert f"WARC-Concurrent-To: {text['record_id']}\r\n" in meta["headers"]
    assert text["source_payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(HTML.encode()).digest()).decode()
    assert text["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(text["block"].encode()).digest()).decode()
    for line in ("httpStatus: HTTP/1.1 200 OK", "sourceHeader-X-Odd: a: b", "title: T & t", "outlink: /x?a=1&b=2"):
        assert line + "\r\n" in meta["block"]
    assert got["<urn:uuid:3>", "conversion"]["block"] == "" and got["<urn:uuid:5>", "conversion"]["block"] == "no head at all"
    warc.write_warc(derived, str(tmp_path / "w"))
    back = {}
    for name in glob.glob(str(tmp_path / "w" / "*.gz")):
        data = gzip.open(name).read()
        while data:  # an independent reader: header, length, block, two line ends
            head, _, data = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and data[n:n + 4] == b"\r\n\r\n"
            back[fields["WARC-Record-ID"]] = (fields["WARC-Type"], data[:n].decode())
            data = data[n + 4:]
    assert back == {r["record_id"]: (r["record_type"], r["block"]) for r in got.values()}
    assert warc.build_derivatives(records(spark, [])).collect() == []


# --- HTML extraction -------------------------------------------------------------------------------------------------

def test_blocks_and_zones():
    page = """<html><head><title>t</title></head><body class="has-sidebar"><!-- x --><header>top</header><nav><a href="a>b">menu</a></nav>plain <b>te</b>xt
      <main><header><h1>Head&shy;line</h1></header><p>One<br>two &lt;3&gt; &eacute;<p>un<i>clos</i>ed<script>var a = "</p>";</script><div class="cookie-notice">eat</div>
      <form>name</form><section id="userComments"><article>first!</article></section></main><aside>side</aside><div hidden>gone</div>after &amp; 1 < 2</body>"""
    got = blocks(page)
    assert [t for t, z in got if z == CONTENT] == ["Head\xadline", "One two <3> é", "unclosed"]
    assert [t for t, z in got if z == PLAIN] == ["plain text", "after & 1 < 2"]
    assert blocks(None) == blocks("") == blocks("<p> &nbsp; </p>") == [] and {z for t, z in got if t in ("menu", "eat", "name", "first!", "side", "top")} == {CHROME}


def test_suffix_array_against_sorting():
    rnd = np.random.default_rng(4)
    for size in (1, 2, 300):
        tokens = rnd.integers(0, 3, size)
        order, common = boilerplate.suffix_array(tokens)
        suffixes = [tuple(tokens[i:]) for i in order]
        assert suffixes == sorted(suffixes)
        for a, b, k in zip(suffixes, suffixes[1:], common[1:]):
            assert a[:k] == b[:k] and (len(a) == k or a[k] != b[k])


def brute_main_texts(rows, min_run=6):
    """By definition, page by page: tiles of every block, contents that have each, and what that says about the block."""
    hosts = {}
    for i, url, html in rows:
        hosts.setdefault((url or "").split("/")[2] if "//" in (url or "") else "", []).append((i, [(t, z) for t, z in blocks(html)]))
    out = {}
    for pages in hosts.values():
        tiles, shown = {}, {}
        contents = {" ".join(t for t, _ in page) for _, page in pages}

        def own(page):
            words = [w for t, z in page if z != CHROME for w in t.split()]
            at = 0
            for t, z in page:
                if z != CHROME:
                    n = len(t.split())
                    starts = [*range(at, at + n - min_run, min_run), at + n - min_run] if n >= min_run else [at] if at + min_run <= len(words) else [at + n - min_run] if at + n >= min_run else []
                    yield t, z, n, [tuple(words[s:s + min_run]) for s in starts]
                    at += n
        for _, page in pages:
            key = " ".join(t for t, _ in page)
            for _, _, _, runs in own(page):
                for r in runs:
                    tiles.setdefault(r, set()).add(key)
            for t, z in page:
                if z == CHROME:
                    shown.setdefault(t, set()).add(key)

        def verdict(n):
            return 3 if n >= 2 and 2 * n > len(contents) >= 10 else 2 if n >= 3 and 4 * n >= len(contents) else 1 if n >= 2 else 0
        for i, page in pages:
            judged = [(t, z, n, min([verdict(len(tiles[r])) for r in runs], default=0)) for t, z, n, runs in own(page)]
            copy = 3 * sum(n for _, z, n, v in judged if z == PLAIN and v == 1) > sum(n for _, _, n, _ in judged)
            out[i] = "\n\n".join(t for t, z, n, v in judged if (z == CONTENT and v < 3 and not (n + 2 >= min_run and verdict(len(shown.get(t, ()))) == 3)) or (z == PLAIN and (v == 0 or v == 1 and copy)))
    return out


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_main_text_against_brute_force(spark, block_bytes):
    rnd = random.Random(12)
    line = lambda low, high: " ".join(rnd.choice("abcdefghij") + rnd.choice("xyz") for _ in range(rnd.randint(low, high)))
    rows = []
    for host in range(4):
        stock = [line(1, 14) for _ in range(8)]
        for k in range([1, 3, 12, 30][host]):
            parts = [f"<{tag}>{rnd.choice(stock) if rnd.random() < 0.6 else line(1, 40)}</{tag}>" for tag in rnd.choices(["div", "p", "nav", "article", "footer"], k=rnd.randint(0, 9))]
            rows.append((len(rows), f"http://h{host}.example/{k}", "".join(parts)))
    rows += [(1000 + i, u, h) for i, (_, u, h) in enumerate(rows[::7])]
    assert texts(spark, rows, block_bytes=block_bytes) == brute_main_texts(rows)


def test_class_words_hide_no_text(spark):
    text = "this is the main text of the page and it stays"
    pages = [f'<main class="page with-sidebar"><p>{text}</p></main>', f'<div class="layout no-sidebar"><article><p>{text}</p></article></div>', f'<div class="content ad-free"><p>{text}</p></div>',
             f'<article id="post-comment-on-budget"><p>{text}</p></article>', f'<div class="sidebar-layout"><main><p>{text}</p></main></div>']
    rows = [(k, f"http://w{k}.example/", f"<body>{p}<div class='comments'><article><p>first!</p></article></div><div class='cookie-banner'>we use cookies</div></body>") for k, p in enumerate(pages)]
    assert texts(spark, rows) == {k: text for k in range(len(pages))}


def test_near_equal_pages_keep_their_text(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(3)]
    page = lambda word: "".join(f"<div>{b}</div>" for b in [*body[:2], body[2] + f" {word} " + body[0][::-1]])
    got = texts(spark, [(1, "http://n.example/1", page("old")), (2, "http://n.example/2", page("new"))])
    assert got[1].count("\n\n") == 2 and got[2] == got[1].replace(" old ", " new ") and " old " in got[1]


def alone(k):
    return " ".join(f"{w}{k}" for w in "unique text of this page stands here by itself".split())


def site(k, article):
    body = f"<article><h1>Title {k}</h1><p>shared passage that all of the articles on this site carry</p><p>own text number {k}</p></article>" if article else f"<div>{alone(k)}</div>"
    return f"<body><div>Welcome to our site and have a look around</div><nav>Home | About</nav>{body}<div>All rights reserved by the owners of it</div><footer>&copy; x</footer></body>"


def test_host_boilerplate(spark):
    rows = [(k, f"http://a.example/{k}", site(k, False)) for k in range(6)] + [(k, f"http://b.example/{k}", site(k, True)) for k in range(10, 16)]
    rows += [(20, "http://c.example/", site(20, False)), (21, None, None), (22, "not a url", ""), (None, "http://a.example/9", site(9, False)), (5, "http://a.example/5", site(5, False))]
    pages = frame(spark, rows, "page_id long, url string, html string")
    got = boilerplate.extract_main_text(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[k] == alone(k) for k in range(6)) and text[None] == alone(9)
    assert all(text[k] == f"Title {k}\n\nshared passage that all of the articles on this site carry\n\nown text number {k}" for k in range(10, 16))
    assert text[20].startswith("Welcome to our site") and text[21] == text[22] == ""
    split = {r["page_id"]: r["text"] for r in boilerplate.extract_main_text(pages, block_bytes=900).collect()}
    assert sorted(split, key=str) == sorted(text, key=str) and all(split[k] == text[k] for k in range(10, 16))
    assert boilerplate.extract_main_text(pages.limit(0)).collect() == []


def texts(spark, rows, **options):
    pages = frame(spark, rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in boilerplate.extract_main_text(pages, **options).collect()}


def test_host_boilerplate_across_blocks(spark):
    """A line that two of 60 pages share, and furniture counts, do not depend on how the host is split."""
    rare, often = "this rare line stands on only two pages of them", "read all the latest stories on our front page"
    rows = [(k, f"http://d.example/{k}", f"<div>{alone(k)}</div>{f'<div>{rare}</div>' if k in (3, 44) else ''}<article><p>own {alone(k + 100)}</p><p>{often}</p></article>") for k in range(60)]
    whole = texts(spark, rows)
    assert whole == {k: f"{alone(k)}\n\nown {alone(k + 100)}" for k in range(60)}
    assert texts(spark, rows, block_bytes=700) == whole


def test_markup_does_not_hide_text(spark):
    """Main text in divs next to a teaser article stays; a line in the articles of most pages goes, one of few pages stays."""
    rows = [(k, f"http://e.example/{k}", f"<div>{alone(k)}</div><article><p>teaser {k}</p><p>share this story with all of your friends today</p>{'<p>a passage that is quoted on just two of the pages</p>' if k < 2 else ''}</article>") for k in range(12)]
    got = texts(spark, rows)
    assert got[5] == f"{alone(5)}\n\nteaser 5" and got[0] == f"{alone(0)}\n\nteaser 0\n\na passage that is quoted on just two of the pages"


def test_copies_and_short_blocks_keep_their_text(spark):
    """One article under several URLs is one content; four shared words in a block of their own are no run."""
    rows = [(k, f"http://f.example/a?utm={k}", f"<!-- {k} --><div>{alone(1)}</div>") for k in range(5)] + [(k, f"http://f.example/{k}", f"<div>{alone(k)}</div><div>four words stand here</div><div>{alone(k + 50)}</div>") for k in (10, 11)]
    got = texts(spark, rows)
    assert all(got[k] == alone(1) for k in range(5)) and all(got[k] == f"{alone(k)}\n\nfour words stand here\n\n{alone(k + 50)}" for k in (10, 11))


def test_repeated_page_is_one_row_of_a_task(spark, monkeypatch):
    """Copies of one page are reduced before they are brought together, and all get their text."""
    rows = [(k, "http://g.example/", f"<div>{alone(1)}</div>") for k in range(300)] + [(400 + k, "http://g.example/2", f"<div>{alone(2 + k)}</div>") for k in range(3)]
    held = boilerplate.main_texts

    def few(table, *rest):
        assert table.num_rows <= 4
        return held(table, *rest)
    monkeypatch.setattr(boilerplate, "main_texts", few)
    got = texts(spark, rows)
    assert len(got) == 303 and all(got[k] == alone(1) for k in range(300)) and got[402] == alone(4)
    monkeypatch.setattr(boilerplate, "MAX_BROADCAST_COPIES", 0)
    monkeypatch.setattr(boilerplate, "COPIES_TOGETHER", 7)
    assert texts(spark, rows) == got
    assert boilerplate.extract_main_text(frame(spark, rows, "page_id long, url string, html string")).count() == 303


# --- mixing ----------------------------------------------------------------------------------------------------------

def test_poisson_inversion(spark):
    from pyspark.sql import functions as F
    rows = [(m, u) for m in (0.0, 0.1, 1.0, 7.5, 300.0) for u in (1e-9, 0.2, 0.5, 0.9, 1 - 1e-12)]
    got = spark.createDataFrame(rows, "m double, u double").select("m", "u", mixing.poisson(F.col("m"), F.col("u")).alias("k")).collect()
    for r in got:
        k, p = 0, math.exp(-r["m"])
        c = p
        while c < r["u"] and r["m"] > 0:
            k += 1
            p *= r["m"] / k
            c += p
        assert r["k"] == k


def test_mixing_hits_targets(spark):
    rows = [(i, "x" * 20, ["a", "b", None][0 if i % 10 else 1 + i % 20 // 10], "kept") for i in range(6000)] + [(None, "no id", "b", None), (9000, None, "b", None), (9001, "", "empty", None)]
    docs = frame(spark, rows, "doc_id long, text string, source string, lang string")
    weights = {"a": 1.0, "b": 2.0, None: 1.0}
    got = mixing.mix(docs, weights, seed=5)
    assert got.columns[:4] == ["doc_id", "text", "source", "lang"] and got.columns.count("copy") == 1
    out = got.collect()
    share = {s: sum(len(r["text"] or "") for r in out if r["source"] == s) / sum(len(r["text"] or "") for r in out) for s in ("a", "b", None)}
    assert abs(share["a"] - 0.25) < 0.03 and abs(share["b"] - 0.5) < 0.03 and abs(len(out) - 6000) < 300
    assert [r["shuffle_key"] for r in out] == sorted(r["shuffle_key"] for r in out)
    copies = {}
    for r in out:
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    again = mixing.mix(docs.repartition(7), weights, seed=5).collect()
    assert [(r["doc_id"], r["copy"]) for r in again] == [(r["doc_id"], r["copy"]) for r in out]
    assert {r["doc_id"] for r in mixing.mix(docs, weights, seed=6).collect()} != set(copies)
    assert mixing.mix(docs.limit(0)).collect() == [] and not any(r["source"] == "empty" for r in mixing.mix(docs).collect())
    with pytest.raises(ValueError, match="repeated"):
        mixing.mix(docs, {"b": 1.0}, size=100, max_mean=500)
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(docs, {"a": -1.0})


def test_mixing_draws_large_means(spark):
    """A source that is tiny beside another has a mean in the thousands."""
    rows = [(0, "x" * 4_000_000, "big"), *[(k, "y", "tiny") for k in range(1, 4)], (4, "z", None)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).select("doc_id", "copy", "shuffle_key").collect()
    scale = (4_000_000 + 4) / (2000 + math.sqrt(3) + 1)
    copies = {}
    for r in out:
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    for k, mean in ((1, scale / math.sqrt(3)), (2, scale / math.sqrt(3)), (3, scale / math.sqrt(3)), (4, scale)):
        parts, want = math.ceil(mean / 500), 0
        for part in range(1, parts + 1):
            u = (int(hashlib.md5(f"11|part|{part}|{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = c = math.exp(-mean / parts)
            n = 0
            while c < u:
                n += 1
                p *= mean / parts / n
                c += p
            want += n
        assert sorted(copies[k]) == list(range(1, want + 1)) and abs(want - mean) < 6 * math.sqrt(mean)
    assert [r["shuffle_key"] for r in out] == sorted(r["shuffle_key"] for r in out)
    same = frame(spark, [(k, "same", "a") for k in range(40)], "doc_id long, text string, source string")
    counts = [r["count"] for r in mixing.mix(same, {"a": 1.0}, size=1200, max_mean=None).groupBy("doc_id").count().collect()]
    assert len(counts) == 40 and abs(np.mean(counts) - 1200) < 5 * math.sqrt(1200 / 40) and 0.4 < np.var(counts) / 1200 < 2


# --- URL lists -------------------------------------------------------------------------------------------------------

def test_temporal_lists(spark):
    day = lambda n: datetime.date(2024, 1, n)
    entries = [("example.com", "block", day(5)), ("example.com", "remove", day(10)), ("example.com", "block", day(20)), ("good.example.com", "allow", day(1)), ("good.example.com", "block", day(8)),
               ("good.example.com", "allow", day(8)), ("http://x.org/p?q", "block", day(3)), ("x.org", "allow", day(1)), (None, "block", day(1)), ("y.org", "what", day(1)), ("z.org", None, day(1)), ("z.org", "block", None)]
    urls = {"http://www.EXAMPLE.com:80/a": None, "https://u:p@good.example.com": None, "http://x.org/p?q": None, "http://x.org/p": None, "http://notexample.com/": None, "nonsense": None, None: None, "http://y.org": None,
            "http://" + "a." * 300 + "z.org/": None}
    captures = [(i, u, day(d) if d else None) for i, (u, d) in enumerate((u, d) for u in urls for d in (1, 4, 5, 8, 9, 10, 20, 31, None))]
    captures.append(captures[0])

    def brute(url, at):
        host = (url or "").split("//")[-1].split("/")[0].split("@")[-1].split(":")[0].lower() if "://" in (url or "") else ""
        best = None
        for pattern in {e[0] for e in entries if e[0]}:
            if not (pattern == url or len(host) <= 253 and (host == pattern or host.endswith("." + pattern))) or at is None:
                continue
            past = [(e[2], -["block", "allow", "remove"].index(e[1])) for e in entries if e[0] == pattern and e[2] and e[1] in ("block", "allow", "remove") and e[2] <= at]
            if past:
                listed, rank = max(past)
                action = ["block", "allow", "remove"][-rank]
                if action != "remove":
                    best = max(best or (False, 0), (pattern == url, len(pattern), pattern, action, listed))
        return (best[3], best[2], best[4]) if best else ("none", None, None)

    listed = frame(spark, entries, "pattern string, action string, dated date")
    got = urllists.evaluate(frame(spark, captures, "page_id long, url string, fetched date"), listed).collect()
    assert sorted(((r["page_id"], r["decision"], r["pattern"], r["listed"]) for r in got), key=str) == sorted(((i, *brute(u, d)) for i, u, d in captures), key=str)
    assert {r["decision"] for r in got} == {"block", "allow", "none"}
    assert {r["decision"] for r in urllists.evaluate(frame(spark, captures, "page_id long, url string, fetched date"), listed.limit(0)).collect()} == {"none"}
