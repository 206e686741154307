"""The operators against brute force, the public libraries, and odd input: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from alnspark.llm import common, exact_dedup, html_text, minhash, mixing, quality, sentencepiece_fst, token_counts, topk, toxicity, transducer, training_pages, url_filter
from alnspark.llm.labelled import sample
from tests.oracle import compare, connect

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t", "a", "A", "it's 'll  don't'S", "x" * 5000, "日本 é😀 \x1c\x85", "<|endoftext|>x<|endoftext|>", "▁▁ a", "word " * 3000]


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", 1, "id", "text2", 1, 2, 3, 4) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, node string, k_id int, size int, digest int, keep_id int")


def noise(seed, n, length=60):
    r = random.Random(seed)
    letters = [*"ab'sdmtlvre  \n\t1ⅷé!?中文😀ÀA", "<|endoftext|>", "'ll", " the", "▁", "\u00a0"]
    return ["".join(r.choices(letters, k=r.randint(0, length))) for _ in range(n)]


# 1


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = ODD + noise(1, 3000)
    want = [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = token_counts.token_counts(documents(spark, texts), BPE, limit=50).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [w > 50 for w in want]
    assert list(token_counts.count_texts(BPE, [t or "" for t in texts], batch_chars=64)) == want  # long texts in parts


def test_token_counts_edges(spark):
    assert token_counts.token_counts(documents(spark, []), BPE).collect() == []
    same = token_counts.token_counts(documents(spark, ["a b", "a b", "c"], [None, 7, 7]), BPE).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in same) == [(-1, 2), (7, 1), (7, 2)]


def test_state_maps_compose():
    r = np.random.default_rng(0)
    classes = r.integers(0, 11, 5000).astype(np.uint8)
    classes[[40, 41, 999, 4999]] = transducer.END
    one = transducer.pretoken_starts(classes, chunk=8000)
    assert all(np.array_equal(one, transducer.pretoken_starts(classes, chunk=c)) for c in (1, 2, 7, 256))


def test_states_can_be_dropped(monkeypatch):
    monkeypatch.setattr(transducer, "MAX_STATES", 50)
    machine, _ = token_counts.load_byte_bpe(BPE)
    texts = noise(3, 200)
    first = list(token_counts.count_texts(BPE, texts, batch_chars=300))
    assert first == list(token_counts.count_texts(BPE, texts, batch_chars=100_000))


# 5


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + noise(2, 3000)
    got = sentencepiece_fst.encode_decode(documents(spark, texts), PIECES).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    want = model.encode(plain, num_threads=1)
    assert [r.pieces for r in got] == want
    assert [r.decoded for r in got] == model.decode(want)
    assert all(r.round_trip == (r.decoded == t) for r, t in zip(got, plain, strict=True))
    assert all(r.round_trip for r, t in zip(got, plain, strict=True) if "▁" not in t)
    assert sentencepiece_fst.encode_decode(documents(spark, []), PIECES).collect() == []


def long_texts():
    """With and without spaces, of one letter and of many, with a letter run that nothing parts."""
    r = random.Random(2)
    letters = lambda n: "".join(r.choices("etaoinshrdlucm", k=n))
    return ["x" * 300_000, letters(60_000), "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(1_000_000)), "-=" * 50_000, "hello world, " * 80_000, letters(9_000) + " 1" + letters(3_000) + "😀" * 5_000]


def test_long_texts_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    texts = long_texts()
    want = [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert list(token_counts.count_texts(BPE, texts)) == want
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)
    codec = sentencepiece_fst.load_codec(PIECES)
    ids, counts = codec.encode(texts)
    assert counts.tolist() == [len(p) for p in pieces] and ids.tolist() == [i for p in pieces for i in p]
    assert codec.decode(ids, counts) == texts


def test_count_maps_of_chunks_compose():
    """Any length of chunk gives the counts and the last pieces of one pass."""
    machine, _ = token_counts.load_byte_bpe(BPE)
    r = random.Random(4)
    data = np.frombuffer("".join(r.choices("ab é中x", weights=[4, 4, 1, 1, 1, 9], k=3000)).encode(), np.uint8)
    starts = np.array([0, 10, 1500])
    lengths = np.array([10, 1490, len(data) - 1500])
    ends = [np.zeros(len(data), np.int32) for _ in range(3)]
    counts = [machine.run(data, starts, lengths, last, lane).tolist() for last, lane in zip(ends, (10_000, 64, 7), strict=True)]
    assert counts[0] == counts[1] == counts[2]
    assert np.array_equal(ends[0], ends[1]) and np.array_equal(ends[0], ends[2])


def test_other_models_are_refused(tmp_path):
    """The file with one field of its normaliser or trainer set otherwise (the last value of a field counts)."""
    whole = open(PIECES, "rb").read()
    message = lambda number, body: bytes([number << 3 | 2, len(body)]) + body
    for name, part in {"kind": message(2, b"\x18\x01"), "map": message(3, b"\x12\x01x\x20\x00"), "prefix": message(3, b"\x18\x00\x20\x00"), "spaces": message(3, b"\x20\x01")}.items():
        (tmp_path / name).write_bytes(whole + part)
        with pytest.raises(ValueError, match="can't be compiled"):
            sentencepiece_fst.check_supported(str(tmp_path / name))
    sentencepiece_fst.check_supported(PIECES)


# 2 and 8


def labelled(spark, texts, y, name):
    return spark.createDataFrame([(k, int(v), int(v)) for k, v in enumerate(y)], "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def filler(r, n):
    return " ".join("".join(r.choices(["ta", "ro", "ne", "li", "ku"], k=3)) for _ in range(n))


def test_quality_learns_and_holds_out(spark):
    r = random.Random(5)
    texts = [filler(r, 40) + ". " + filler(r, 10) if k % 3 else " ".join([r.choice(["buy", "now!!", "ta"])] * 60) for k in range(400)]
    y = [int(k % 3 > 0) for k in range(400)]
    got = quality.classify_quality(documents(spark, texts), labelled(spark, texts, y, "quality")).collect()
    assert all(x.held_out == held(x.doc_id) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    out = [x for x in got if x.held_out]
    assert np.mean([x.predicted == y[x.doc_id] for x in out]) > 0.95
    kept = quality.keep_good(documents(spark, texts), labelled(spark, texts, y, "quality"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in got if x.predicted) and "node" in kept.columns


def test_labels_of_held_out_rows_are_not_used(spark):
    r = random.Random(6)
    texts = [filler(r, 30) + (" bad" if k % 2 else "") for k in range(300)]
    y = [k % 2 for k in range(300)]
    turned = [1 - v if held(k) else v for k, v in enumerate(y)]
    for f in (quality.classify_quality, toxicity.score_toxicity):
        a, b = ({x.doc_id: x.score for x in f(documents(spark, texts), labelled(spark, texts, v, "x")).collect()} for v in (y, turned))
        assert a == b


def test_the_sample_is_bounded_with_repeated_rows(spark):
    """Rows repeated beyond the bound on characters: as many as were chosen come back, and each text is moved once."""
    docs = documents(spark, ["long text " * 9] * 9 + ["short"] * 3, [1] * 9 + [2] * 3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = sample(docs, labels, "quality", chars=200, holding_out=False)
    assert sorted(got) == [("long text " * 9, 1)] * 2 + [("short", 0)] * 3
    assert sample(docs, labels, "quality", rows=0, holding_out=False) == []


def test_toxicity_finds_the_sentence(spark):
    r = random.Random(7)
    texts, y = [], []
    for k in range(500):
        lines = [filler(r, 8).capitalize() + "." for _ in range(6)]
        if k % 4 == 0:
            lines[r.randrange(6)] = f"Such a {r.choice(['vilewort', 'grimtail'])} {filler(r, 3)}!"
        texts.append(" ".join(lines))
        y.append(int(k % 4 == 0))
    got = toxicity.score_toxicity(documents(spark, texts), labelled(spark, texts, y, "toxic")).collect()
    assert np.mean([x.predicted == y[x.doc_id] for x in got if x.held_out]) > 0.97
    for x in got:
        for s in x.offending:
            assert "vilewort" in texts[x.doc_id][s.start : s.stop] or "grimtail" in texts[x.doc_id][s.start : s.stop]
    assert sum(len(x.offending) for x in got) >= 110


def test_toxicity_of_long_texts(spark):
    """Long clean text stays clean, one bad sentence in it is found where it is; long texts are trained on too."""
    r = random.Random(8)
    lines = [filler(r, 8).capitalize() + ". " for _ in range(3000)]
    texts = ["".join(r.sample(lines, 5)) + ("vilewort again. " if k % 4 == 0 else "") for k in range(300)]
    texts += ["".join(lines) * 7, "".join(lines) * 2 + "vilewort again. " + "".join(lines) * 5]
    y = [int(k % 4 == 0) for k in range(300)] + [0, 1]
    assert len(texts[-1]) > 1_000_000
    got = {x.doc_id: x for x in toxicity.score_toxicity(documents(spark, texts), labelled(spark, texts, y, "toxic")).collect()}
    assert got[300].predicted == 0 and not got[300].offending
    assert got[301].predicted == 1 and [texts[301][s.start : s.stop].strip() for s in got[301].offending] == ["vilewort again."]
    long = ["".join(lines), "".join(lines[:1000]) + "vilewort again. " + "".join(lines[1000:])] * 20  # all of them long
    only = toxicity.score_toxicity(documents(spark, long), labelled(spark, long, [0, 1] * 20, "toxic")).collect()
    assert [x.predicted for x in sorted(only, key=lambda x: x.doc_id)] == [0, 1] * 20


def test_quality_of_long_texts():
    r = random.Random(8)
    model = quality.QualityModel().fit([(filler(r, 40) if k % 2 else "buy now " * 30, k % 2) for k in range(100)])
    text = filler(r, 150_000)
    assert len(text) > 4 * quality.PIECE
    at = list(common.pieces(text, quality.PIECE, (quality.BLANK,)))
    assert len(at) > 2 and at[0][0] == 0 and at[-1][1] == len(text) and all(a[1] == b[0] and text[a[1] - 1] == " " for a, b in zip(at[:-1], at[1:], strict=True))
    whole = [np.concatenate([b for b, _ in quality.features([t], 18)]) for t in (text, *(text[a:b] for a, b in at))]
    assert np.array_equal(np.sort(whole[0]), np.sort(np.concatenate(whole[1:])))
    assert model.score([text])[0] > 0.9 and model.score(["x" * 2_000_000]).shape == (1,)


@pytest.mark.parametrize("f", [quality.classify_quality, toxicity.score_toxicity])
def test_classifiers_edges(spark, f):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = f(documents(spark, ODD, [None, 1, 1, *range(2, len(ODD) - 1)]), none).collect()
    assert len(got) == len(ODD) and all(0 <= x.score <= 1 and x.held_out is not None for x in got)
    assert f(documents(spark, []), none).collect() == []
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(f(documents(spark, ODD), nulls).collect()) == len(ODD)


# 3


def test_extraction_on_unseen_layouts():
    model = html_text.default_model()
    pages = training_pages.labelled_pages(150, 77)
    clean = [p.replace(training_pages.OPEN, "").replace(training_pages.CLOSE, "") for p in pages]
    good = bad = missed = 0
    for page, got in zip(pages, model.texts(clean), strict=True):
        want = " ".join(re.findall(f"{training_pages.OPEN}(.*?){training_pages.CLOSE}", page, re.S))
        a, b = set(want.split()), set(got.split())
        good, bad, missed = good + len(a & b), bad + len(b - a), missed + len(a - b)
    assert good / (good + bad) > 0.93 and good / (good + missed) > 0.93


def test_extraction_of_a_page(spark):
    body = "<article><h1>A &amp; B</h1><p>One  <b>t</b>wo&nbsp;&#233;.<br>Three <p>Four &lt;x&gt;</article>"
    page = f'<html><head><title>T</title><style>p{{}}</style><script>"</p>"</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy now.</div>{body}<section id="comments"><h2>Comments</h2><p>I liked it.</p></section><footer>&copy; us</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>plain words here, and some more of them."), (1, "u", page), (5, "x", "<" * 2000), (6, "y", "<div>" * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.main_text(df).collect()}
    assert html_text.main_text(df).count() == 7
    text = "A & B One two é. Three Four <x>"
    assert got[1, "u"] == (text, len(text)) and got[2, None] == ("", 0) and got[3, "v"] == ("", 0)
    assert html_text.main_text(df.limit(0)).collect() == []


#: Pages written by hand, with their main text; no generator takes part.
PAGES = [
    ("<article><p>one<b> </b>two</p></article>", "one two"),
    ("<p>one<b> </b>two</p>", "one two"),
    ("<article><p>one<span></span> <i>two</i></p></article>", "one two"),
    ("<article><p>o<b>n</b>e\n <!-- x --> two</p>\n<p>three</article>", "one two three"),
    ("<article><p>AT&<b>lt;</b> rest</p></article>", "AT&lt; rest"),
    ("<article><h1>T</h1><div>Plain div text here.</div><h4>Sub four</h4><h5>Sub five</h5><dl><dt>Term</dt><dd>Meaning of it.</dd></dl><details><summary>More</summary><p>Hidden part.</p></details></article>", "T Plain div text here. Sub four Sub five Term Meaning of it. More Hidden part."),
    ("<html><body><nav><a href=x>Home</a></nav><main><p>A paragraph.</p><p>Another one with words.</p></main><footer>c</footer></body></html>", "A paragraph. Another one with words."),
    ("<body><div class=menu><a href=x>Home</a> <a href=y>Away</a></div><div class=content><p>First par of it.</p><p>Second par of it.</p><p>Third one, longer than the others by a few words.</p></div><div class=footer>Copyright us</div></body>", "First par of it. Second par of it. Third one, longer than the others by a few words."),
    ("<article class=comment-worthy><h1>Title</h1><p>Some text of this article.</p></article>", "Title Some text of this article."),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be so. <object data=a>Fallback words</object> end.</p></article>", "Let x=2 be so. Fallback words end."),
    ("<article><h1>Title here</h1><p>Text.</p><section class=comments><h2>Comments</h2><article class=comment><p>I liked it very much. Really.</p></article></section></article>", "Title here Text."),
    ("<body><header><h1>Site name</h1></header><div><div><h2>Story</h2><p>It began on a cold day. Nobody knew why.</p><p>Then it ended.</p></div><div><ul><li><a href=1>One link</a><li><a href=2>Two link</a></ul></div></div></body>", "Story It began on a cold day. Nobody knew why. Then it ended."),
    ("<table><tr><td><p>A page laid out in a table, long ago, with an article in a cell. It goes on for a while.</p></td><td><a href=1>a</a><br><a href=2>b</a></td></tr></table>", "A page laid out in a table, long ago, with an article in a cell. It goes on for a while."),
    ("<main><div><p>Deep one.</p></div><aside><p>Not me. At all.</p></aside><form><p>Not me.</p><input></form></main>", "Deep one."),
    ("<article><p>x</p></article>", "x"),
    ("<body><nav><a href=1>Home</a><a href=2>News</a></nav>" + "".join(f"<div>{x} went out.</div>" for x in "Ann Bob Cid Dan Eve Fay Gus Hal".split()) + "<footer>About us</footer></body>", " ".join(f"{x} went out." for x in "Ann Bob Cid Dan Eve Fay Gus Hal".split())),
    ("<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div><div>It rained.</div><div>We stayed in.</div><div>Then it was over.</div></div><footer>Imprint</footer>", "It rained. We stayed in. Then it was over."),
    ("<h1>A title</h1><div>The first paragraph of it.</div><div>And the second one.</div>", "A title The first paragraph of it. And the second one."),
    ("<body><h2>A title</h2><div>The first paragraph of it, with a few more words. It has two sentences.</div><div>And the second one.</div></body>", "A title The first paragraph of it, with a few more words. It has two sentences. And the second one."),
    ("This page has no markup at all. It is text, and all of it counts.", "This page has no markup at all. It is text, and all of it counts."),
    ("Short text.\n\nMore &amp; more of it.", "Short text. More & more of it."),
]


def test_parsing_is_linear():
    """Nested elements, stray end tags, and elements that look for what they end."""
    import time

    n = 100_000
    for page in ("<div>" * n + "</span>" * n, "<p><button>" + "<b>" * n + "<hr>" * n, "<ul><li>" + "<i>" * n + "</u></b>" * n, "<table>" + "<tr><td>" * n):
        start = time.process_time()
        html_text.parse(page)
        assert time.process_time() - start < 4


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_extraction_of_pages_by_hand(page, text):
    assert html_text.default_model().texts([page]) == [text]


def test_extraction_of_a_long_page():
    model = html_text.default_model()
    words = "word " * 200_000
    assert model.texts([f"<nav><a href=x>Home</a></nav><article><p>{words}</p>{'<p>Short one.</p>' * 5000}</article>"]) == [f"{words}{'Short one. ' * 5000}".strip()]


def test_marginals_are_exact():
    """Messages against the sum over all labellings of a small tree."""
    tree = html_text.parse("<div><p>a<b>c</b></p><ul><li>d</ul></div>")
    forest = html_text.Forest([tree])
    r = np.random.default_rng(1)
    weight, pair = r.normal(size=html_text.WEIGHTS), r.normal(size=(html_text.WEIGHTS, 2, 2))
    local = np.bincount(forest.of, weights=weight[forest.feature], minlength=forest.n)
    total, mass = 0.0, np.zeros(forest.n)
    for code in range(1 << forest.n):
        y = [(code >> k) & 1 for k in range(forest.n)]
        e = sum(local[k] * y[k] for k in range(forest.n)) + sum(pair[forest.edge[k], y[forest.parent[k]], y[k]] for k in range(1, forest.n))
        total += np.exp(e)
        mass += np.exp(e) * np.array(y)
    assert np.allclose(np.exp(html_text.marginals(forest, weight, pair)[0][:, 1]), mass / total)
    assert html.unescape("&am") == "&am"


# 4


def test_url_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "a.example.net/en/x"), ("allow", "org/fr/")]
    urls = ["http://net/", "http://x.NET/a", "http://x.net", "https://www.example.net/en/1?q", "https://a.example.net/en/xyz#t", "https://fr.org/fr/", "http://example.org/en/", "no-scheme.net/", None, "http://x.net?/a", "ftp://x.net:80/a", "://net/", "http://a.b://c.net/"]
    df = spark.createDataFrame([(k, u, "r", "h") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, url_filter.rule_table(spark, rules)).collect()}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(e), v, e) for v, e in rules if (f".{host.lower()}").endswith("." + e.split("/")[0]) and path.startswith(e[e.index("/") :])]
        want = max(fits)[1:] if fits else ("allow", None)
        assert (got[k].host, got[k].path, got[k].verdict, got[k].rule) == (host.lower(), path, *want), u
    assert url_filter.filter_urls(df.limit(0), url_filter.rule_table(spark, rules)).collect() == []
    twice = url_filter.filter_urls(df.unionByName(df).withColumn("page_id", F.lit(None).cast("long")), url_filter.rule_table(spark, rules))
    assert twice.count() == 2 * len(urls)


def test_a_host_of_very_many_labels(spark):
    """Only suffixes as long as a rule's host are made."""
    rules = url_filter.rule_table(spark, [("block", "b.example.net/"), ("allow", "org/")])
    hosts = ["a." * 100_000 + "b.example.net", "a." * 100_000 + "org", "x" * 300_000 + ".net"]
    df = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(hosts)], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.rule) for r in url_filter.filter_urls(df, rules).collect()) == [(0, "block", "b.example.net/"), (1, "allow", "org/"), (2, "allow", None)]


def test_url_rules_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    rules = url_filter.rule_table(spark, [("block", "net/"), ("allow", "example.net/en/")])
    df = spark.createDataFrame([(k, f"http://{h}/en/") for k, h in enumerate(["a.net", "example.net", "b.com"])], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.rule) for r in url_filter.filter_urls(df, rules).collect()) == [(0, "block", "net/"), (1, "allow", "example.net/en/"), (2, "allow", None)]


# 6


def brute_components(texts, ids, k, percent):
    sets = []
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    comp = dict(zip(ids, ids, strict=True))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                comp[b] = a
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    r = random.Random(9)
    texts = list(ODD)
    for _ in range(12):
        base = filler(r, r.choice([2, 12, 60, 120])).split()
        for _ in range(9):
            words = list(base)
            for _ in range(r.randrange(0, 5)):
                words[r.randrange(len(words))] = r.choice(["zz", "Yy", "xx"])
            texts.append(" ".join(words))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = minhash.near_duplicates(documents(spark, texts, ids), k, percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(texts, ids, k, percent)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    kept = minhash.keep_one(documents(spark, texts, ids), k, percent)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in got if x.kept)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []
    got = minhash.near_duplicates(documents(spark, ["a b", "A b", "a b", None], [None, 4, 4, 5])).collect()
    assert sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1, x.kept) for x in got) == [(-1, 1, -1, True), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True)]


def test_shingles_are_exact():
    """Words that collide under any polynomial hash modulo 2**64, and texts whose words so do."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    spaced = lambda t: " ".join(t)
    texts = [a, b, a + " x", spaced(a), spaced(b), spaced(a) + " b", "a b", "a b c", "A  b\tC"]
    for k in (1, 3, 5):
        numbers, hashes = minhash.shingles([minhash.words_of(t) for t in texts], k)
        sets = []
        for t in texts:
            w = t.lower().split()
            sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
        assert [len(n) for n in numbers] == [len(h) for h in hashes] == [len(s) for s in sets]
        for i in range(len(texts)):
            for j in range(len(texts)):
                both = len(sets[i] & sets[j])
                assert len(np.intersect1d(numbers[i], numbers[j])) == len(np.intersect1d(hashes[i], hashes[j])) == both


def test_unlike_texts_that_collide_are_not_linked(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    got = minhash.near_duplicates(documents(spark, [a, b, a.upper()])).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(0, 0), (1, 1), (2, 0)]


def test_near_duplicates_with_repeated_ids(spark):
    """Rows are judged by their own texts; keep_one() loses no text that nothing else stands for."""
    r = random.Random(3)
    x, y = filler(r, 40), filler(r, 40)
    z = y + " zz"
    df = documents(spark, [x, y, z, x + " q", None, None, "", x], [4, 4, 2, 7, 9, 9, None, 4])
    got = minhash.near_duplicates(df).collect()
    assert sorted((-1 if g.doc_id is None else g.doc_id, -1 if g.component_id is None else g.component_id, g.kept) for g in got) == [(-1, -1, True), (2, 2, True), (4, 2, False), (4, 4, True), (4, 4, True), (7, 4, False), (9, 9, True), (9, 9, True)]
    assert sorted((g.doc_id or 0, g.text or "") for g in minhash.keep_one(df).collect()) == sorted([(0, ""), (2, z), (4, x), (4, x), (9, ""), (9, "")])
    one = documents(spark, [y, z], [3, 3])
    assert [g.component_id for g in minhash.near_duplicates(one).collect()] == [3, 3] and minhash.keep_one(one).count() == 1


def test_near_duplicates_of_long_texts(spark):
    r = random.Random(4)
    w = filler(r, 150_000).split()
    edited = list(w)
    for k in range(0, len(w), 100):
        edited[k] = "zz"
    far = list(w)
    for k in range(0, len(w), 10):
        far[k] = "zz"
    texts = [" ".join(w), " ".join(edited), " ".join(far), "x" * 1_000_000]
    assert len(texts[0]) > 1_000_000
    got = minhash.near_duplicates(documents(spark, texts)).collect()
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == brute_components(texts, [0, 1, 2, 3], 5, 80)


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 3000)]
    out = minhash.sketch([*sets, np.zeros(0, np.uint64)], 352)
    assert (out[:5] != 2**64 - 1).all() and (out[5] == 2**64 - 1).all()
    a, b = sets[4][:2000], sets[4][1000:]
    x, y = minhash.sketch([a, b], 352)
    assert abs((x == y).mean() - 1000 / 3000) < 0.1


# 7


def test_top_k_against_sql(spark):
    from alnspark.llm.queries import ORACLES, QUERIES

    assert compare(spark, QUERIES["op7_topk"], ORACLES["op7_topk"], SMALL) == ""


def test_top_k_kernel_against_brute_force():
    """Blocks of posting lists one after the other, thresholds carried along; skewed, tied, zero, few and very large components."""
    r = np.random.default_rng(3)
    cases = [np.floor(r.standard_cauchy((700, 16)) * 2).astype(np.int64), r.integers(0, 2, (700, 4)), np.zeros((300, 4), np.int64), r.integers(-3, 3, (5, 4)), r.integers(-(2**26), 2**26, (300, 8)), r.integers(-(2**62), 2**62, (300, 3)) * 2]
    for v in cases:
        ids, asked = np.arange(len(v)), np.arange(0, len(v), 20)
        best, got = np.full((len(asked), 7), -np.inf), {int(i): [] for i in asked}
        for a in range(0, len(v), 200):
            block = topk.Block(ids[a : a + 200], v.shape[1], topk.impact_segments(v[a : a + 200]))
            assert (block.v == v[a : a + 200]).all()
            for row, vec, score in zip(*topk.search_block(v[asked], asked, block, 7, best, few=2), strict=True):
                got[int(asked[row])].append((-int(score), int(block.ids[vec])))
        whole = v[asked].astype(object) @ v.astype(object).T
        for k, i in enumerate(asked):
            assert sorted(got[int(i)])[:7] == sorted((-min(max(int(s), topk.LEAST), topk.MOST), int(j)) for s, j in zip(whole[k], ids, strict=True) if j != i)[:7]


def test_top_k_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "ROUND_BYTES", 1)
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=3)]) for k in range(90)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), k=4, block=16).collect()
    v = np.floor(64 * np.array([x for _, x in rows])).astype(int)
    want = [(q, n + 1, i, -s) for q in range(0, 90, 20) for n, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in range(90) if i != q)[:4])]
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == want


def test_top_k_edges(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in r.normal(size=4)], 0) for k in range(60)]
    rows += [(60, None, 0), (61, [1.0, None, 0.0, 0.0], 0), (62, [1.0, float("nan"), 0.0, 0.0], 0), (63, [float("inf"), 0.0, 0.0, 0.0], 0), (None, [1.0] * 4, 0), (64, [1.0, 2.0], 0), (80, [3.0, 1.0], 0), (100, [], 0), (20, rows[20][1], 0)]
    rows += [(k, [0.5] * 4, 0) for k in range(200, 260)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, k=5, block=16).collect()
    whole = {}
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if q % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:5]
            whole[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert {q: sorted((x["rank"], x.vec_id, x.score) for x in got if x.query_id == q) for q in {x.query_id for x in got}} == {q: s for q, s in whole.items() if s}
    assert topk.top_k(df.limit(0)).collect() == []


# 9


def test_mixing(spark):
    r = random.Random(11)
    texts = ODD + [filler(r, r.choice([1, 5, 50, 400])) for _ in range(400)]
    df = documents(spark, texts)
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))  # reruns agree
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    assert {x.doc_id: x["size"] for x in got} == size
    sources = sorted({x.source for x in got}, key=lambda s: (s is None, s))
    total = {s: sum(x["size"] for x in got if x.source == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:  # share what is left by weight until none is above twice its size
        left = 1.5 * sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    for x in got:
        assert x.source_size == total[x.source] and abs(x.target - target[x.source]) < 1e-6 * (1 + x.target) and 0 <= x.taken <= 2 * x["size"]
    for s in sources:
        assert abs(sum(x.taken for x in got if x.source == s) - target[s]) < 0.01 * target[s] + 64
    rows = mixing.mixed(df).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in rows} == {x.doc_id: n for x in got if x["size"] and (n := int(x.taken / x["size"] + 0.5))}
    assert mixing.mix(documents(spark, [])).collect() == []
    assert [x.taken for x in mixing.mix(documents(spark, [None, " "])).collect()] == [0, 0]


def test_mixing_stage_keeps_shares(spark):
    """A hot source of low weight, whose runs are shorter than its documents; ids are repeated, null, or shared by a blank text."""
    import corpus_pipeline

    rows = [("s02", f"h{k} " * (300, 900, 2500)[k % 3]) for k in range(225)]  # 27 % of all words, weight 1
    rows += [(f"s{3 * j:02}", f"x{j}y{k} " * (100, 700)[k % 2]) for j in range(7) for k in range(268)]
    rows += [(f"s{j:02}", "one two") for j in range(19) if j % 3] + [(None, "a b c"), ("s02", None), ("s02", " ")]
    schema = "doc_id long, source string, text string"
    df = spark.createDataFrame([(None if k % 50 == 0 else k // 2, s, t) for k, (s, t) in enumerate(rows)] + [(1, "s02", "")], schema)
    taken = mixing.mix(df).collect()
    out = [(x.doc_id, x.source, x.text) for x in corpus_pipeline.sources(spark, df, SMALL).collect()]
    assert sorted(out, key=str) == sorted(((x.doc_id, x.source, x.text) for x in corpus_pipeline.sources(spark, df.repartition(7), SMALL).collect()), key=str)
    assert all(t.strip() for _, _, t in out) and max(out.count(x) for x in set(out)) <= 2
    for s in {x.source for x in taken}:
        mine = [x for x in taken if x.source == s]
        got, longest = sum(len(t.split()) for _, o, t in out if o == s), max(x["size"] for x in mine)
        assert abs(got - sum(x.taken for x in mine)) <= longest and abs(got - mine[0].target) <= longest + 64, s
    long = [x.taken for x in taken if x["size"] == 2500]
    assert 0 < sum(long) < 0.3 * 2500 * len(long) and abs(sum(len(t.split()) == 2500 for *_, t in out) - sum(long) / 2500) < 2


def lague(sizes, seats):
    """Seats of each size by the highest quotients, ties to the first."""
    bids = sorted((-s / (2 * n + 1), k, n) for k, s in enumerate(sizes) if s for n in range(seats))[:seats]
    return [sum(b[1] == k for b in bids) for k in range(len(sizes))]


def test_apportionment_is_sainte_lague(spark):
    r = random.Random(2)
    cases = [([53000, 24000, 23000, 7, 0, 11111], 100), ([1] * 9, 4), ([5, 5, 5, 1], 7), ([10**6] + [1] * 40, 500), ([0, 0], 3), ([3, 2], 0), ([r.randint(0, 999) for _ in range(60)], 200), ([int(1.5**k) for k in range(30)], 3000)]
    rows = [(c, k, s, n) for c, (sizes, n) in enumerate(cases) for k, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "part int, key int, size long, seats long")
    got = {(x.part, x.key): x.quota for x in mixing.apportion(df, ["part"], [F.col("key")], "size", "seats").collect()}
    assert got == {(c, k): q for c, (sizes, n) in enumerate(cases) for k, q in enumerate(lague(sizes, n))}
    many = spark.createDataFrame([(k, 1000 + k % 7, 10**8) for k in range(100)], "key int, size long, seats long")
    done = mixing.apportion(many, [], [F.col("key")], "size", "seats")
    assert done.agg(F.sum("quota")).first()[0] == 10**8 and all(abs(x.quota - x["size"] * 10**8 / sum(1000 + k % 7 for k in range(100))) <= 1 for x in done.collect())


def test_mixing_against_brute_force(spark):
    """taken of every row, by dealing the blocks of each shard one by one; ids are unique, sources hot, small, blank and null."""
    import xxhash

    def chained(*values):
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64(v.encode() if isinstance(v, str) else v, seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    number, wide = (lambda v: v.to_bytes(4, "little")), (lambda v: v.to_bytes(8, "little"))
    r = random.Random(8)
    rows = [(k, r.choice(["a", "a", "a", "b", "c", None]), "w " * r.choice([0, 1, 3, 40, 300])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x.doc_id: x for x in mixing.mix(df, shard_words=1000).collect()}
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    size = {k: len(t.split()) for k, _, t in rows}
    target = [next(x.target for x in got.values() if x.source == s) for s in names]
    seats = lague(target, round(sum(target) / 16))
    for s, n in zip(names, seats, strict=True):
        mine = [k for k, o, _ in rows if o == s]
        shards = min(mixing.MAX_SHARDS, max(1, -(-sum(size[k] for k in mine) // 1000)))
        of = {k: chained(number(7), wide(k)) % shards for k in mine}
        used = sorted(set(of.values()))
        quota = dict(zip(used, lague([sum(size[k] for k in mine if of[k] == h) for h in used], n), strict=True))
        for h in used:
            order = sorted((k for k in mine if of[k] == h), key=lambda k: (chained(number(8), wide(k)), k))
            words = [k for k in order for _ in range(size[k])]
            begin = chained(number(9), s, number(h)) % max(1, -(-len(words) // 16)) * 16
            n_words = min(quota[h] * 16, 2 * len(words))
            taken = {k: n_words // len(words) * size[k] if words else 0 for k in order}
            for j in range(n_words % len(words) if words else 0):
                taken[words[(begin + j) % len(words)]] += 1
            assert {k: got[k].taken for k in order} == taken


# 10


def test_exact_dedup(spark):
    texts = [*ODD, "Straße", "STRAßE", "É", "é", "same", "SAME", "same"] + ["hot"] * 200
    got = exact_dedup.exact_dedup(documents(spark, texts)).collect()
    groups = {}
    for k, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        groups.setdefault(hashlib.sha256(low.encode()).hexdigest(), []).append(k)
    want = {k: (max(g), len(g), k == max(g), d) for d, g in groups.items() for k in g}
    assert {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got} == want
    assert sorted(x.doc_id for x in exact_dedup.keep_last(documents(spark, texts)).collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_dedup(documents(spark, [])).collect() == []
    nulls = exact_dedup.exact_dedup(documents(spark, ["a", "A", "b"], [None, 3, None])).collect()
    assert sorted((x.doc_id or -1, x.keep_id or -1, x.group_size, x.kept) for x in nulls) == [(-1, -1, 1, True), (-1, 3, 2, False), (3, 3, 2, True)]


def test_index_persists(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "digest_test", str(tmp_path / "index"))
    first = exact_dedup.exact_dedup(documents(spark, ["a", "b", "B"]), index).collect()
    assert sorted((x.doc_id, x.kept) for x in first) == [(0, True), (1, False), (2, True)]
    again = exact_dedup.exact_dedup(documents(spark, ["A", "c"], [10, 11]), exact_dedup.DigestIndex(spark, "digest_test", str(tmp_path / "index"))).collect()
    assert sorted((x.doc_id, x.keep_id, x.kept) for x in again) == [(10, 0, False), (11, 11, True)]
    assert index.table().count() == 3
    spark.sql("DROP TABLE digest_test")


def test_a_batch_may_be_run_again(spark, tmp_path, monkeypatch):
    """A job that fails after the append, or amid it, gives the rows of an undisturbed one when it is run again."""
    index = exact_dedup.DigestIndex(spark, "digest_retry", str(tmp_path / "index"))
    exact_dedup.exact_dedup(documents(spark, ["old", "a"], [90, 91]), index)
    batch = documents(spark, ["A", "b", "B", "c", None, "d"])
    want = [(0, 91, False), (1, 2, False), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True)]

    def stop(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "materialise", lambda df, tag, **kw: stop() if tag == "known" else common.materialise(df, tag, **kw))
        with pytest.raises(RuntimeError, match="killed"):
            exact_dedup.exact_dedup(batch, index)
    assert index.table().count() == 6
    for _ in range(2):
        got = exact_dedup.exact_dedup(batch, index).collect()
        assert sorted((x.doc_id, x.keep_id, x.kept) for x in got) == want
    # half of the append of a named batch, as a failed commit leaves it
    half = exact_dedup.digests(documents(spark, ["x"], [20])).selectExpr("digest", "id keep_id", "1L group_size", "'b2' batch")
    half.write.format("parquet").mode("append").bucketBy(index.buckets, "digest").sortBy("digest").option("path", index.path).saveAsTable(index.name)
    got = exact_dedup.exact_dedup(documents(spark, ["x", "y"], [20, 21]), index, batch="b2").collect()
    assert sorted((x.doc_id, x.kept) for x in got) == [(20, True), (21, True)]
    assert [x.kept for x in exact_dedup.exact_dedup(documents(spark, ["y"], [30]), index, batch="b3").collect()] == [False]
    assert index.table().count() == index.table().select("digest").distinct().count() == 8
    index.drop()


def test_no_table_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.exact_dedup(documents(spark, ["a", "a"])).count() == 2
    assert {t.name for t in spark.catalog.listTables()} == before


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda _: str(tmp_path))
    minhash.near_duplicates(documents(spark, ["a b c d", "a b c d e"])).collect()
    exact_dedup.exact_dedup(documents(spark, ["a", "a"])).collect()
    assert sorted(re.sub("-[0-9a-f]{32}$", "", p.name) for p in tmp_path.iterdir()) == ["exact-dedup", "near-duplicates"]


def test_scratch_needs_a_shared_folder():
    class Cluster:
        master = "spark://host:7077"
        conf = sparkContext = property(lambda self: self)
        get = staticmethod(lambda key, default=None: default)
        getConf = lambda self: self

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Cluster())


@pytest.mark.parametrize("name", ["op4_url_filters", "op10_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    from alnspark.llm.queries import ORACLES, QUERIES

    assert compare(spark, QUERIES[name], ORACLES[name], SMALL) == ""


def test_pipeline(spark):
    """Each stage against brute force on its own input."""
    import corpus_pipeline
    from alnspark.llm.common import materialise, table

    docs = table(spark, SMALL, "documents")
    bad = {r[0] for r in connect(SMALL).execute("SELECT doc_id FROM labels WHERE quality = 0").fetchall()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect()
        docs = materialise(stage(spark, docs, SMALL), name)
        after = [r.doc_id for r in docs.collect()]
        seen[name] = len(after)
        if name == "quality":
            gone = {r.doc_id for r in before} - set(after)
            known = {r[0] for r in connect(SMALL).execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
            assert len(gone & known) <= 0.02 * len(known) and len(gone & bad) >= 0.6 * len(bad)
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[re.sub("[A-Z]", lambda m: m[0].lower(), r.text)] = max(r.doc_id, best.get(re.sub("[A-Z]", lambda m: m[0].lower(), r.text), -1))
            assert sorted(after) == sorted(best.values())
        if name == "near_dedup":
            want = brute_components([r.text for r in before], [r.doc_id for r in before], 5, 80)
            assert sorted(after) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "mixing":
            assert set(after) <= {r.doc_id for r in before} and max(after.count(i) for i in set(after)) <= 2
        if name == "sentencepiece":
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before) and all(r.round_trip and r.decoded == texts[r.doc_id] for r in docs.collect())
    assert corpus_pipeline.run(spark, SMALL).count() == seen["sentencepiece"]
