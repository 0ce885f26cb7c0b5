import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from framewright.llm import bpe, decontaminate, edit_counts, html_text, quality, token_files, toxicity

BITS = ["a", "foo", " ", "  ", "\n", "\t", " \n", "'s", "'ll", " 's", "é", "12", " 34", "!!", "<|endoftext|>", "\xa0", "\x1c", "\x85", "　", "日本", "​", "🙂", "\0", " bar", " Baz."]


def noise(n, size=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_ranks()), special_tokens={})


def messy(spark, texts=()):
    rows = [(1, "plain words here", "en", None, 3), (1, "plain words here", "en", "s", 3), (None, "no id", None, None, None), (2, None, None, "s", None), (3, "", "en", "s", 0), (4, "long " * 60_000, "en", "s", 1)]
    rows += [(10 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1.5 as score", "'x' as predicted", "7 as n", "'k' as key", "0 as label")


def test_chunks_are_stitched_exactly(own):
    tool = bpe.ChunkedBpe(bpe.default_ranks(), public_tokenizers.PATTERN, chunk=12, overlap=4)
    for t in [*noise(3000), "x" * 5000, " " * 5000, "\n" * 100 + "end"]:
        assert "".join(tool.pieces(t)) == t
        ids = tool.encode(t)
        assert ids == own.encode_ordinary(t) and tool.decode(ids) == t.encode()
    assert max(len(tool.pieces(t)) for t in noise(50, 200)) > 3


def test_bpe_rows(spark, own):
    texts = noise(40)
    got = {r["doc_id"]: r for r in bpe.op9_rows(messy(spark, texts), chunk=64).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t)
        assert (got[10 + i]["n_tokens"], got[10 + i]["ids_sha256"], got[10 + i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and got[4]["n_tokens"] == len(own.encode_ordinary("long " * 60_000))
    assert bpe.encode_documents(messy(spark).limit(0)).count() == 0


@pytest.mark.parametrize("special", [True, False])
def test_cached_tokenizer_is_the_library(special):
    tool = token_files.CachedTokenizer(token_files.default_tokenizer(), memory=20_000, special_strings=special)
    library = Tokenizer.from_file(token_files.default_tokenizer())
    library.encode_special_tokens = not special
    texts = [*noise(4000, seed=2), "x" * 5000, "日" * 3000, "a<|endoftext|> b", "<|endoftext|>"]
    got = tool.encode_many([*texts, None, ""])
    for t, g, e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert " ".join(tool.pieces(t)) == t
        assert np.frombuffer(g, "<u4").tolist() == e.ids, t
    assert got[-2:] == [b"", b""] and tool.held <= 20_000 + 4000 * 400
    assert (50256 in library.encode("a<|endoftext|> b", add_special_tokens=False).ids) == special


def test_words_go_through_the_model_once(monkeypatch):
    """However marks and lines stand between them: 1600 different pieces between spaces, of 40 words."""
    tool = token_files.CachedTokenizer(token_files.default_tokenizer())
    words = [f"{a}{b}" for a in ("onthe", "reti", "Überall", "añeja") for b in ("shon", "tion", "ed", "ê", "her", "an", "ouer", "st", "ble", "wh")]
    texts = [f"{a}.\n{b} and" for a in words for b in words]
    texts = [" ".join(texts[k : k + 40]) for k in range(0, 1600, 40)]
    given = []

    class Counted:
        def encode_batch_fast(self, batch, bare=tool.bare, **options):
            given.extend(batch)
            return bare.encode_batch_fast(batch, **options)

    monkeypatch.setattr(tool, "bare", Counted())
    got = tool.encode_many(texts)
    library = Tokenizer.from_file(token_files.default_tokenizer())
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sum(map(len, given)) < 3000 < sum(map(len, texts)) // 10


def test_cuts_are_where_no_pre_token_spans():
    tool = token_files.CachedTokenizer(token_files.default_tokenizer(), memory=200_000)
    library = Tokenizer.from_file(token_files.default_tokenizer())
    rng = random.Random(8)
    bits = ["a", "foo", " ", " ", "\n", "'s", "'", "'S", "é", "ñ", "×", "÷", "ª", "µ", "²", "½", "e\u0301", "\u0301", "12", "!!", ".", ",", "_", "(", " bar", "Baz.", ".\n", "\n\n", "日本", "🙂", "\0", "\\1", "x" * 70]
    white = ["  ", "\t", "\r\n", "\x1f", "\x1c", "\x85", "\xa0", "\u3000", " \n", "\n "]
    texts = ["".join(rng.choice(bits + white * (i % 2)) for _ in range(rng.randint(0, 25))) for i in range(6000)]
    texts += [f"{c} {c}x{c}.\n{c}y{c}\n.{c} z" for c in map(chr, range(1, 0x250))]
    for t, g, e in zip(texts, tool.encode_many(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(g, "<u4").tolist() == e.ids, t


def test_batches_are_encoded_in_parts(spark, monkeypatch):
    docs = messy(spark, noise(60, seed=9)).coalesce(1)
    want = sorted(map(tuple, token_files.op4_rows(docs).collect()), key=lambda r: r[1])
    monkeypatch.setattr(token_files, "ROWS", 7)
    assert sorted(map(tuple, token_files.op4_rows(docs).collect()), key=lambda r: r[1]) == want and len(want) == 66


def test_hot_ids_are_cut_within():
    data = [bytes([i]) for i in range(200)]
    ids = np.array([5] * 198 + [4, 6])
    shard = token_files.shard_of(ids, data, np.array([5, 5, 5, 5]))
    assert len(set(shard[:198].tolist())) == 5 and shard[198] == 0 and shard[199] == 4
    order = sorted(range(198), key=lambda i: zlib.crc32(data[i]))
    assert shard[order].tolist() == sorted(shard[:198].tolist())


def test_parts_of_long_texts_are_encoded_apart(spark, own, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHUNKS", 3)
    texts = [*noise(25, 600, seed=6), "word " * 900, "x" * 3000, " " * 2000 + "end", "日本語、" * 700, "a\n" * 1500]
    got = {r["doc_id"]: r for r in bpe.op9_rows(messy(spark, texts).where("doc_id <> 4"), chunk=400).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t)
        assert (got[10 + i]["n_tokens"], got[10 + i]["ids_sha256"], got[10 + i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), i


def test_token_shards(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i * 3 - 5, rng.integers(0, 50257, n).astype(np.uint32)) for i, n in enumerate((5, 0, 70_000, 3, 100, 0, 1))]
    out = io.BytesIO()
    assert token_files.write_shard(docs, out, width=2, frame_ids=64) == sum(len(x) for _, x in docs)
    reader = token_files.ShardReader(io.BytesIO(out.getvalue()))
    assert [(i, x.tolist()) for i, x in reader] == [(i, x.tolist()) for i, x in docs]
    assert reader.document(4).tolist() == docs[4][1].tolist()
    # frames are plain zstandard one after another
    import zstandard

    assert len(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()) == 2 * sum(len(x) for _, x in docs)
    bad = bytearray(out.getvalue())
    bad[10] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.ShardReader(io.BytesIO(bytes(bad))))
    empty = io.BytesIO()
    token_files.write_shard([], empty)
    assert list(token_files.ShardReader(empty)) == []


def test_token_file_rows(spark):
    texts = noise(60, seed=3)
    out_dir = token_files.shared_dir(spark, "test")
    token_files.write_token_files(messy(spark, texts), out_dir, shards=4)
    got = token_files.read_token_files(spark, out_dir).collect()
    assert spark.read.parquet(f"{out_dir}/index.parquet").count() > 1
    library = Tokenizer.from_file(token_files.default_tokenizer())
    want = {}
    rows = sorted([(-(2**63), "no id"), (1, "plain words here"), (1, "plain words here"), (2, ""), (3, ""), (4, "long " * 60_000), *((10 + i, t) for i, t in enumerate(texts))], key=lambda r: r[0])
    start = 0
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.setdefault(None if i < 0 else i, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    have: dict = {}
    for r in sorted(got, key=lambda r: r["start"]):
        have.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert have == want
    assert token_files.op4_rows(messy(spark).limit(0)).count() == 0


def test_edits_leave_the_count_of_the_new_text():
    count = edit_counts.Counter(edit_counts.default_ranks(), edit_counts.default_pattern())
    rng = random.Random(5)
    for t in noise(600, 120, seed=4):
        tree = edit_counts.build(t, count, 16)
        edits = [(rng.randint(0, len(t) + 5), rng.randint(0, 30), "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 3, 80])))) for _ in range(4)]
        new, tree, _, _ = edit_counts.apply_edits(t, tree, edits, count, 16)
        assert (tree.tokens[1], tree.chars[1]) == (count(new), len(new))


def test_edit_rows(spark):
    texts = noise(80, 200, seed=9) + ["これは文です。" * 6000, "line\n" * 9000, "12ab" * 8000]
    got = {r["doc_id"]: r for r in edit_counts.op3_rows(messy(spark, texts)).collect()}
    count = edit_counts.Counter(edit_counts.default_ranks(), edit_counts.default_pattern())
    for i, t in [(4, "long " * 60_000), (2, ""), *((10 + k, t) for k, t in enumerate(texts))]:
        after, n = t, len(t)
        for pos, deleted, inserted in ((n // 4, 12, "Rewritten words"), (n // 2, 0, " and a sentence, put in between. "), (3 * n // 4, 40, "")):
            pos = min(pos, len(after))
            after = after[:pos] + inserted + after[pos + deleted :]
        assert (got[i]["n_tokens"], got[i]["n_tokens_after"], got[i]["n_chars_after"]) == (count(t), count(after), len(after)), i
        # what is encoded for an edit doesn't grow with the text, in any script
        assert got[i]["n_chars"] < 3 * 4096
    assert edit_counts.op3_rows(messy(spark).limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, sorry, yes, really.</div>
<div id="main"><div class="post"><h1>Title &amp; more</h1><p>First  paragraph, with <b>bold</b>, commas, and
 more text that goes on and on, and on, until it is long enough to count.<p>Second&nbsp;one, also, quite long, with an <a href="x">a link</a> inside, and so on, and so on.
<ul><li>one<li>two</ul><blockquote>Quoted &lt;text&gt;, here.</blockquote></div>
<div class="comments"><p>Great article, thanks, really, I liked it, a lot, and more, and more, and more.</p></div></div>
<aside class="sidebar"><p>Other, things, to, read, here, now, please, click, them.</p></aside><form><p>Mail, please, now, and, then.</p></form><footer>&copy; all</footer></body></html>"""


def test_article_without_its_surroundings():
    text = html_text.main_text(PAGE)
    assert text.split("\n") == [
        "Title & more", "First paragraph, with bold, commas, and more text that goes on and on, and on, until it is long enough to count.",
        "Second one, also, quite long, with an a link inside, and so on, and so on.", "one", "two", "Quoted <text>, here.",
    ]
    assert html_text.main_text("") == html_text.main_text(None) == "" and html_text.main_text("<p>just, a, paragraph") == "just, a, paragraph"
    assert html_text.main_text("<" * 50 + "x" * 10 + "</div></p><p><b>open") != ""
    deep = "<div>" * 3000 + "<p>deep, text</p>" + "</div>" * 3000
    assert html_text.main_text(deep) == "deep, text"


def test_names_that_mark_surroundings():
    out = "comment-body ad-slot sidebar-content relatedPosts commentList footer-text cookie-banner".split()
    assert all(html_text.unwanted("div", n) for n in out) and html_text.unwanted("article", "comment")
    assert not any(html_text.unwanted("div", n) for n in ("post has-sidebar", "article-body", "content no-comments", "headline", "shadow", "main-content side", ""))
    body = "".join(f"<p>Sentence {k}, which is long, and goes on, to count for something here.</p>" for k in range(4))
    page = f"<body><div class='wrap'><div class='content'>{body}</div><div class='comment-body'><p>Nice, really, nice, I mean it, all of it, honestly, yes.</p></div></div></body>"
    assert html_text.main_text(page).count("\n") == 3 and "Nice" not in html_text.main_text(page)


SENTENCES = "".join(f"<p>Sentence {k}, which is long, and goes on, to count for something here.</p>" for k in range(4))


def test_wrappers_are_not_left_out():
    for page in (
        f"<body><form id=aspnetForm><div><a href=/>Home</a></div><div id=main><h1>Title</h1>{SENTENCES}</div><label>q</label><input></form></body>",
        f"<body><div class='search-page'><nav>x</nav><h1>Title</h1>{SENTENCES}</div></body>",
        f"<body><article><header><h1>Title</h1></header>{SENTENCES}</article><footer>f</footer></body>",
        f"<body><div class='comment-list'><article class=comment>{SENTENCES * 2}</article></div><article><h1>Title</h1>{SENTENCES}</article></body>",
    ):
        lines = html_text.main_text(page).split("\n")
        assert lines[0] == "Title" and len(lines) == 5 and lines[4].startswith("Sentence 3"), page
    assert html_text.main_text(f"<body><article><h1>T</h1><p>Short, one.</p></article><div class=comments>{SENTENCES * 2}</div></body>") == "T\nShort, one."


def test_generated_pages_give_their_articles():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n)) + ", " + word() + "."
    around = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=x>{say(2)}</a>' for _ in range(5))}</ul></nav>", lambda: f"<div class='ad'>{say(12)}</div>", lambda: f"<aside><p>{say(15)}</p></aside>",
        lambda: f"<div class='cookie-banner'><p>{say(10)}</p></div>", lambda: f"<form><p>{say(5)}</p><input></form>", lambda: f"<script>var a='<p>{say(9)}</p>'</script>", lambda: f"<div id=comments><p>{say(30)}</p><p>{say(30)}</p></div>",
    ]
    for _ in range(150):
        want, body = [], []
        for _ in range(rng.randint(2, 9)):
            text = say(rng.randint(8, 40))
            kind = rng.choice(["p", "h2", "li", "q", "open"])
            body.append({"p": f"<p>{text}</p>", "h2": f"<h2>{text}</h2>", "li": f"<ul><li>{text}</li></ul>", "q": f"<blockquote>{text}</blockquote>", "open": f"<p>{text.replace(' ', ' <b>', 1)}</b>"}[kind])
            want.append(text)
        body.append(f"<p>{(last := say(25))}</p><p>{(end := say(25))}</p>")
        want += [last, end]
        parts = [rng.choice(around)() for _ in range(rng.randint(0, 4))]
        open_, close = rng.choice([("<article>", "</article>"), ("<div class=content>", "</div>"), ("<main>", "</main>"), ("<div id=main-content><div>", "</div></div>")])
        parts.insert(rng.randint(0, len(parts)), open_ + "".join(body) + close)
        assert html_text.main_text(f"<html><body>{''.join(parts)}<footer>{say(4)}</footer></body></html>").split("\n") == want


def test_broken_pages_take_linear_time():
    import time

    broken = ["<a ", "<h1>x", "<p><button><h1>x", "<li>", "<td>x", '<a b="', "<i>", "<span><p>x, y", "<div class='ad'>", "<!--", "</", "<ul><li>"]
    for start in broken:
        spent = []
        for size in (40_000, 320_000):
            began = time.process_time()
            html_text.main_text(start * (size // len(start)) + "</b>" * 1000)
            spent.append(time.process_time() - began)
        assert spent[1] < 1 + 24 * spent[0], (start, spent)  # eight times the text


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 9), (1, None, None, 9), (None, "u", "", 9)], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert len(got) == 3 and {r["n_chars"] for r in got if r["text"] == ""} == {0}
    assert html_text.extract(df.limit(0)).count() == 0


def test_automaton_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
        return row[-1]

    words = {"abcde": 3.0, "abcdefghi": 2.0, "xyz": 4.0, "bcdea": 1.0}
    auto = toxicity.LexiconAutomaton(words, {"stem": 5.0}, limit=20)
    rng = random.Random(1)
    for _ in range(4000):
        w = rng.choice(list(words) + ["stem"])
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcxyz") + w[i:], w[:i] + rng.choice("abcxyz") + w[i + 1 :]])
        hit = w.startswith("stem") or any(distance(w, e) <= toxicity.edits_allowed(len(e)) for e in words)
        assert bool(auto.match(w)[1]) == hit, w


def labelled(spark):
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        toxic, good = i % 4 == 0, i % 3 > 0
        if toxic:
            words[5:5] = rng.sample(["hateful", "nastyword", "vileness"], 2)
        text = " ".join(words) if good else "!! ".join(words).upper()
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    for rows, label in ((toxicity.op2_rows(docs, labels), "toxic"), (quality.op8_rows(docs, labels), "quality")):
        got = rows.join(labels, "doc_id").where("held_out").collect()
        assert len(got) > 60 and sum(r["predicted"] == r[label] for r in got) >= 0.95 * len(got)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)


def test_a_full_table_of_words_loses_no_hit(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    tool, small = toxicity.Scorer(model), toxicity.Scorer(model, memory=3)
    texts = [r["text"] for r in docs.limit(80).collect()] + ["nastywrd " * 5 + '"hateful" ' * 4]
    assert [small.score(t) for t in texts] == [tool.score(t) for t in texts]
    assert len(small.known) <= 5


def test_scores_follow_from_edit_distances(spark):
    """Features against plain edit distances and a plain reading of quotation marks and words of reporting."""
    model = toxicity.ToxicModel({"hateful": 3.0, "vermin": 2.0}, {}, (1.0, 1.0, 1.0, 0.5, -2.0), frozenset({"vermit"}), frozenset({"vermin"}), frozenset({"said"}))
    tool = toxicity.Scorer(model)
    log = lambda x: float(np.log1p(x))
    for text, want in {
        "hateful one": [3.0, 0, 0, 0], "hatefil two": [0, 2.7, 0, 0], "vermim": [0, 0, 1.8, 0], "vermit": [0, 0, 0, 0], "he said hateful": [0, 0, 0, 3.0], 'a "hateful thing" b': [0, 0, 0, 3.0],
        'so "x" is hateful and "y"': [3.0, 0, 0, 0], "hateful vermin": [5.0, 0, 0, 0], "": [0, 0, 0, 0],
    }.items():
        assert tool.features(text) == pytest.approx([log(x) for x in want]), text


def test_misspellings_and_quotations(spark):
    docs, labels = labelled(spark)
    tool = toxicity.Scorer(toxicity.fit_toxicity(docs, labels))
    assert tool.score("you are nastywrd and hateful") > 0.5 > tool.score("w1 w2 w3")
    assert tool.score('he was told off because he said "nastyword" to them') < tool.score("you nastyword you")


def test_classifiers_on_messy_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, 1), (None, 1, 0), (2, 0, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (empty, some):
        for rows in (toxicity.op2_rows(messy(spark), labels), quality.op8_rows(messy(spark), labels)):
            got = rows.collect()
            assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
            assert rows.limit(0).count() == 0
    assert toxicity.op2_rows(messy(spark).limit(0), some).count() == 0


def plain_bm25(items, query):
    """Shares of each item's own score by the formula, without an index."""
    bags = [decontaminate.words_of(t) for _, t in items]
    mean = sum(map(len, bags)) / len(bags)
    idf = {w: math.log(1 + (len(bags) - d + 0.5) / (d + 0.5)) for w in {w for b in bags for w in b} for d in [sum(w in b for b in bags)]}
    part = lambda w, b: idf[w] * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean))
    return {i: sum(part(w, b) for w in set(b) & query) / sum(part(w, b) for w in set(b)) for (i, _), b in zip(items, bags) if b}


def index_of(items):
    bags = [(i, t, Counter(decontaminate.words_of(t))) for i, t in items]
    df = Counter(w for _, _, b in bags for w in b)
    bags = [x for x in bags if x[2]]
    whole = decontaminate.Statistics(len(bags), sum(sum(b.values()) for _, _, b in bags) / len(bags))
    return decontaminate.Bm25Index([(i, t, list(b), list(b.values()), [df[w] for w in b]) for i, t, b in bags], whole)


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(7)
    vocab = [f"t{k}" for k in range(80)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 20)))) for i in range(90)]
    ix = index_of(items)
    for _ in range(200):
        query = {rng.choice(vocab).encode() for _ in range(rng.randint(1, 50))}
        ids = [ix.ids[w] for w in query if w in ix.ids]
        scores = plain_bm25(items, query)
        want = {(i, round(s, 9)) for i, s in scores.items() if s >= 0.5}
        got = ix.search(list(ix.lists(np.array(ids, np.int64)).values()), 0.5)
        assert {(ix.items[k].item_id, round(s, 9)) for k, s in got} == want
        assert {k // decontaminate.BLOCK for k, _ in got} <= set(ix.live(np.array(ids, np.int64), 0.5).tolist())


def test_scores_do_not_depend_on_the_number_of_indexes(spark):
    rng = random.Random(4)
    vocab = [f"t{k}" for k in range(60)] + ["日", "本", "語"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 70)))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as shard", "'x' as terms")
    texts = {}
    for i in range(40):
        w = items[i][1].split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts[100 + i] = " ".join(rng.choice(vocab) for _ in range(300)) + " " + " ".join(w) + " end"
    docs = spark.createDataFrame([*texts.items(), (None, items[0][1]), (7, None), (7, ""), (8, items[1][1]), (8, items[1][1])], "doc_id long, text string").selectExpr("*", "2 as item_id", "'s' as score")
    limits = decontaminate.Limits(0.8, 0.3, 0.3)
    one, many = (sorted(map(tuple, decontaminate.find_leaks(docs, bench, limits, most=m).collect()), key=repr) for m in (50_000, 10))
    assert one == many and len(one) > 30 and sum(r[0] == 8 and r[1] == 1 for r in one) == 2
    # each row's score is the plain one of its passage
    sizes = {i: len(t.split()) for i, t in items}
    for doc_id, item_id, score, *_, first in one:
        if doc_id in texts:
            words = decontaminate.words_of(texts[doc_id])
            assert plain_bm25(items, set(words[first : first + 256 * -(-sizes[item_id] // 64)]))[item_id] == pytest.approx(score)


def test_leaks_in_scripts_without_spaces(spark):
    item = "これは試験の問題文でありその答えは四十二である"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "前の文に続いて" + item + "という長い一文になる"), (2, "まったく別の文がここにある")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()] == [1]


def test_leaks_found_and_clean_texts_left(spark):
    rng = random.Random(8)
    vocab = [f"t{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{say(25)}. {say(8)}.") for i in range(40)] + [(None, "no id"), (77, None), (78, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"{say(rng.randint(0, 900))} {items[i][1].upper()} {say(200)}" if i < 20 else say(600)) for i in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(messy(spark).select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in docs], "doc_id long, text string")), bench).collect()}
    assert got == {(100 + i, i) for i in range(20)}
    clean = decontaminate.without_leaks(messy(spark), bench)
    assert clean.count() == 6 and clean.columns == messy(spark).columns
    assert decontaminate.find_leaks(messy(spark), bench.limit(0)).count() == 0
    assert sum(map(len, decontaminate.index_shards(bench, most=10))) > 1 and decontaminate.index_shards(bench.limit(0)) == []
