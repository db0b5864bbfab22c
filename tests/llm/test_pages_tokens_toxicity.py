import html
import math
import random
import re
import time

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from strataforge.llm import html_extract, token_counts, toxicity

DATA = "/root/testdata/sf0.001"


def test_main_text_of_a_page():
    page = '<html><body><header class="site-header"><p>Site</p></header><div id="cookie-notice">We use cookies.</div><div class="main-content"><h1>T &amp; x</h1><p>First paragraph, long\n enough. It has text.</p><p>Short.</p><form>Subscribe</form><div class="ad">Buy</div></div><aside>side</aside><div class="comments"><p>Nice one!</p></div><footer>c</footer>'
    assert html_extract.main_text(page) == "T & x\nFirst paragraph, long enough. It has text.\nShort."
    assert [html_extract.main_text(x) for x in (None, "", "<script>x", "<!-- a", "plain &lt; text", "<nav><a>x</a></nav><footer>c, d.</footer>")] == ["", "", "", "", "plain < text", ""]


STORY = "<p>The first paragraph of the story says what has happened, and to whom, at length enough.</p><p>Another one follows; it holds a quotation, 'like this', and more words.</p><p>Short end.</p>"
TOLD = ["The first paragraph of the story says what has happened, and to whom, at length enough.", "Another one follows; it holds a quotation, 'like this', and more words.", "Short end."]


@pytest.mark.parametrize(
    "page",
    [
        "<body><div><a href=x>Home</a> <a>News</a></div><div><h1>Title</h1>{}</div><div>© 2024 us</div></body>",
        "<body><ul><li><a>Home</a><li><a>About</a></ul><h1>Title</h1>{}</body>",
        "<body><div class='layout has-sidebar'><div><h2>Title</h2>{}</div><div class='sidebar'><p>Most read, this week: nothing much, they say.</p></div></div></body>",
        "<body><div class='post no-comments'><h1>Title</h1>{}</div><section id=comments><div class=comment><p>I do not agree, as it is wrong, and a long comment proves it, surely.</p></div></section></body>",
        "<body><div><svg/><h1>Title</h1>{}<svg><text>x</text></svg></div></body>",
        "<body><div><h1>Title</h1>{}</div><div class=related><article><a href=x>Other story</a></article></div></body>",
        "<table><tr><td><a>Home</a><br><a>News</a></td><td><h1>Title</h1>{}</td></tr></table>",
        "<body><header>Site name, the best.</header><main><header><h1>Title</h1></header>{}</main>",
    ],
)
def test_articles_that_no_name_marks(page):
    assert html_extract.main_text(page.format(STORY)).split("\n") == ["Title", *TOLD]


def plain_ratios(blocks):
    """Ratios again from (path, text, linked, weight), paths being tuples; counted over for each block."""

    def ratio(chosen, weight):
        chars = sum(w * (len(t) - (1 - html_extract.LINK_SHARE) * x) for _, t, x, w in chosen) / len(chosen)
        stops = sum(w * len(re.findall("[.,;:!?]", t)) * (1 - x / len(t)) for _, t, x, w in chosen) / len(chosen)
        return math.log1p(weight * chars * (1 + stops))

    out = []
    for k, (path, _, _, weight) in enumerate(blocks):
        near = [blocks[j] for j in (k - 1, k + 1) if 0 <= j < len(blocks) and blocks[j][0][:-1] == path[:-1] and blocks[j][3] == weight]
        own = lambda p: ratio([b for b in blocks if b[0] == p], 1.0)
        smooth = (own(path) + html_extract.NEIGHBOUR * sum(own(b[0]) for b in near)) / (1 + html_extract.NEIGHBOUR * len(near))
        out.append((smooth + ratio([b for b in blocks if b[0][:-1] == path[:-1]], weight)) / 2)
    return out


def test_ratios_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        page, blocks = "", []
        for _ in range(rng.randint(1, 12)):
            box, weight = rng.choice([("section", 1.0), ("div", 1.0), ("footer", html_extract.WEIGHT)])
            page += f"<{box}>"
            for _ in range(rng.randint(1, 4)):
                tag, text, link = rng.choice(["p", "pre"]), " ".join(rng.choice(["word", "it,", "end."]) for _ in range(rng.randint(1, 30))), rng.choice(["", "", "more links"])
                page += f"<{tag}>{text} <a>{link}</a></{tag}>"
                blocks.append(((box, tag), f"{text} {link}".strip(), len(link), weight))
            page += f"</{box}>"
        found = html_extract.ratios(html_extract.read(page))
        assert all(abs(a - b) < 1e-9 for a, b in zip(found, plain_ratios(blocks), strict=True))


def test_ratios_decide(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    with_ratios = [html_extract.main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "ratios", lambda page: html_extract._weights(page))
    assert sum(html_extract.main_text(p) != t for p, t in zip(pages, with_ratios)) > 0.9 * len(pages)


@pytest.mark.parametrize("piece", ["<a '", "<a ", "<div>x", "<!--", '<a x="', "<script>", "</p>", "<p><b>", "<svg>", "<div class=ad>x", "&#", "<", "<div></p>"])
def test_broken_markup_takes_linear_time(piece):
    began = time.time()
    html_extract.main_text(piece * ((1 << 20) // len(piece)))
    assert time.time() - began < 15


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("text", F.lit(1)).withColumn("path", F.lit("x"))
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        words = html.unescape(re.sub(r"<[^>]*>", " ", inside)).split()
        assert got[r["page_id"]]["text"].split() == words and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert html_extract.extract(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>a"), (1, "u", "<p>a")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_extract.extract(odd).collect()) == ["", "", "a", "a"]


def test_counts_equal_the_library(spark):
    """The library's own model file and encoder say what is right, on whole documents and on odd texts."""
    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.VOCABULARY)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("x"))).collect()}
    assert got == {r["doc_id"]: len(model.encode(r["text"] or "")) for r in docs.collect()}
    rng, counter = random.Random(1), token_counts.Counter(token_counts.read_vocabulary(token_counts.VOCABULARY))
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", " ", "  ", "é", "😀", "\n", "<s>", "the", "▁", "ß", "<0x0A>", "ing", "tion", "   ", "\t", "中", "12", "//"]) for _ in range(rng.randint(0, 30)))
        assert counter.count(text) == len(model.encode(text)), text
    for text in ("a" * 50_000, " " * 3_000, "é中" * 20_000, "abcdefgh" * 8_000):
        assert counter.count(text) == len(model.encode(text))
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "a"), (2, "a")], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(odd).collect()) == [0, 0, 1, 1]
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_memory_of_counts_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED_BYTES", 5_000)
    counter = token_counts.Counter(token_counts.read_vocabulary(token_counts.VOCABULARY))
    for k in range(300):
        counter.count("x" * (k * 7))
        assert sum(100 + 4 * len(s) for s in counter.known) == counter.held < 10_000


def test_unigram_counts_equal_the_tokenizer():
    """The other rule, on a vocabulary of scores; its pieces are written here, the tokenizer is the library's."""
    small = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("aba", -3.0), ("ba", -2.0), ("bab", -3.5)]
    t = Tokenizer(models.Unigram(small, 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter, rng = token_counts.Counter(token_counts.Vocabulary(dict(small[1:]), False, False)), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", " ", "  ", "é", "😀", "▁", "ß"]) for _ in range(rng.randint(0, 30)))
        assert counter.count(text) == len(t.encode(text, add_special_tokens=False).ids), text


def test_segments_hold_the_best_one():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-2, -1, -0.5, 1, 2, 3]) for _ in range(rng.randint(1, 25))]
        found = toxicity.segments(scores)
        best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
        assert max((s for _, _, s in found), default=best) == best or best <= 0 and not found
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    docs, labels = [], []
    for k in range(600):
        text = [word() for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(["vileone", "viletwo", "vilethree"]) for _ in range(rng.randint(2, 5))]
        docs.append((k, " ".join(text)))
        labels.append((k, toxic))
    docs += [(900, None), (None, ""), (901, "fine")]
    table, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.held_out_toxicity(table, marks).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(docs) and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(not r["predicted"] for r in toxicity.held_out_toxicity(table, marks.limit(0)).collect())
    assert toxicity.held_out_toxicity(table.limit(0), marks).count() == 0
