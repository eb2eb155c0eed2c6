import random
import time
import re

import pytest

from sparkloom.llm import html_text as ht, sentence_pieces as sp, token_counts as tc
from sparkloom.llm.queries import TOKENIZERS

MODEL, RANKS = f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = ["", " ", "   ", "a", " a  b\n\n c   ", "日本語 テスト 😀", "x" * 70, "\n \n", "é  é", "def f(x):\n    return  x+1\n\t\tif  y:", "w" + " " * 70 + "w", "\x00\x7f", "it's we'll 12 345"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop   \nétß!.,(){}[]1234567890ABC'") for _ in range(r.randrange(1, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return sp.load(MODEL)


def test_pieces_equal_the_library(model, spark, data):
    import sentencepiece

    library, encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL), sp.Encoder(model)
    texts = TEXTS + random_texts(1500) + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    ids, at = encoder.encode(texts)
    back = encoder.decode(ids, at)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t), t[:80]
        assert back[k] == t.encode()


def test_runs_of_marks(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for n in [*range(2, 70), 1000]:
        assert model.merge_run(n) == library.encode(" " * (n - 1), out_type=str)


def test_unigram_viterbi_equals_the_library(tmp_path):
    """The same pieces as a unigram model: the trainer's kind field of the file is set to 1."""
    import sentencepiece

    raw = open(MODEL, "rb").read()
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")
    changed = raw[: at + 9] + b"\x01" + raw[at + 10 :]
    library = sentencepiece.SentencePieceProcessor()
    try:
        library.load_from_serialized_proto(changed)
    except (AttributeError, RuntimeError) as e:
        pytest.skip(f"the library does not take the changed model: {e}")
    model = sp.Model(changed)
    assert model.kind == sp.Model.UNIGRAM
    encoder = sp.Encoder(model)
    texts = [t for t in TEXTS if "  " not in t] + [" ".join(t.split()) for t in random_texts(200, 7)]
    ids, offsets = encoder.encode(texts)

    def total(pieces):
        return sum(model.score[k] for k in pieces if model.type[k] == model.NORMAL)

    for k, t in enumerate(texts):
        mine = ids[offsets[k] : offsets[k + 1]].tolist()
        assert encoder.decode(*encoder.encode([t])) == [t.encode()]
        assert total(mine) >= total(library.encode(t)) - 1e-3


def test_piece_frames(spark, model):
    rows = [(1, "a b", 3), (2, None, 3), (3, "", 3), (None, "a b", 3), (1, "a b", 3), (4, "long " * 30_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    enc = sp.encode_pieces(df, model)
    assert all(r.exact for r in enc.collect()) and enc.count() == len(rows)
    assert [(r.doc_id, r.text) for r in sp.decode_pieces(enc, model).collect()] == [(i, t or "") for i, t, _ in rows]
    assert sp.encode_pieces(df.where("false"), model).count() == 0


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(open(RANKS, "rb").read())


def test_pattern_is_the_tokenizers():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert public_tokenizers.PATTERN == tc.PATTERN


def test_edits_equal_full_encoding(counter):
    r, letters = random.Random(3), "ab're's't'll 12  \n\n\t.,é日<>x"
    for _ in range(800):
        s = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 30, 300, 2000])))
        tree = tc.TokenTree(s, counter)
        for _ in range(r.randrange(1, 8)):
            a = r.randrange(len(s) + 1)
            b, new = min(len(s), a + r.choice([0, 0, 1, 2, 5, 50, 400])), "".join(r.choice(letters) for _ in range(r.choice([0, 0, 1, 3, 20, 500])))
            s = s[:a] + new + s[b:]
            tree.edit(a, b, new)
            assert tree.text() == s and tree.total == len(counter.encoding.encode_ordinary(s)) and tree.n_pieces == len(counter.pattern.findall(s))


def test_an_edit_encodes_little(counter):
    tree = tc.TokenTree("lorem ipsum dolor " * 5000, counter)
    tree.edit(40_000, 40_005, "amet")
    assert tree.encoded < 20


def test_count_frames(spark, counter):
    mail = "write to a.b@c.org or 10.0.0.1, token = \"abcdef12\" now"
    rows = [(1, mail, 3), (2, None, 3), (3, "", 3), (None, "x y", 3), (1, mail, 3), (4, "word " * 50_000, 3)]
    got = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), RANKS).collect()
    redacted = 'write to <email> or <ip>, token = "<secret>" now'
    n = lambda t: len(counter.encoding.encode_ordinary(t or ""))
    assert [(r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_edits) for r in got] == [(i, n(t), n(redacted if t == mail else t), 3 if t == mail else 0) for i, t, _ in rows]
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def test_vocabularies_of_one_length_are_told_apart(spark, counter, tmp_path):
    """A file of the same length without one of the tokens counts as itself."""
    lines = open(RANKS, "rb").read().splitlines()
    a = next(k for k in range(300, 400) if tc.base64.b64decode(lines[k].split()[0]).isalpha())
    text = (tc.base64.b64decode(lines[a].split()[0]).decode() + "\n") * 3 + "other words"
    changed = list(lines)
    changed[a] = tc.base64.b64encode(b"\xff" * (len(tc.base64.b64decode(lines[a].split()[0])))) + b" " + lines[a].split()[1]
    other = tmp_path / "other.tiktoken"
    other.write_bytes(b"\n".join(changed))
    assert len(other.read_bytes().strip()) == len(open(RANKS, "rb").read().strip())
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    one, two = (tc.token_counts(df, p).first().n_tokens for p in (RANKS, other))
    assert one == len(counter.encoding.encode_ordinary(text)) and two == len(tc.Counter(other.read_bytes()).encoding.encode_ordinary(text)) != one


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, accept them all now please.</div>
{body}
<aside>Related reading</aside><div id="comments"><p>First! What a long comment by a reader this is, really long.</p></div><form><p>Subscribe</p></form><footer>&copy; x</footer></body></html>"""
ARTICLE = "<h1>A &amp; B</h1><p>One  long\n paragraph of <b>real</b> text that goes on and on for quite a while.<br><p>Second paragraph, also long enough to be taken for the text.</p><div class=ad>Buy!</div><ul><li>point</li></ul><p>End.</p>"
TEXT = "A & B\nOne long paragraph of real text that goes on and on for quite a while.\nSecond paragraph, also long enough to be taken for the text.\npoint\nEnd."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>"])
def test_main_text(wrap):
    assert ht.main_text(PAGE.replace("{body}", wrap.format(ARTICLE))) == TEXT


def test_main_text_without_article():
    assert ht.main_text(PAGE.replace("{body}", "<div>" + ARTICLE + "</div>")) == TEXT


def test_main_text_without_article_is_whole():
    assert ht.main_text(PAGE.replace("{body}", "<div>" + ARTICLE + "</div>")) == TEXT
    long = "word " * 40
    page = f"<div><h1>Head</h1></div><div class=x><ul><li><a href=/a>One page</a></li><li><a href=/b>Two page</a></li></ul></div><div>{''.join(f'<p>{long}</p>' for _ in range(3))}<section><h2>Next</h2></section><ul><li>point</li></ul><table><tr><td>cell</td></tr></table><p>End</p></div>"
    assert ht.main_text(page).split("\n") == ["Head", *[long.strip()] * 3, "Next", "point", "cell", "End"]


@pytest.mark.parametrize("wrap", ["<div class='site has-sidebar'>{}</div>", "<div id='content' class='right-sidebar'>{}</div>", "<div class='search-results'>{}</div>", "<div class='widget'><article>{}</article></div>", "<form><main>{}</main></form>", "<div>{}<div class=related><article>Teaser</article></div></div>"])
def test_wrappers_named_like_parts(wrap):
    assert ht.main_text(PAGE.replace("{body}", wrap.format(ARTICLE))) == TEXT


def test_names_of_parts():
    assert not any(map(ht.names_part, ["related-work", "notice-period", "has-sidebar", "search-results", "site", ""]))
    assert all(map(ht.names_part, ["x comments", "cookie-notice", "site-footer", "comment-12", "main_nav", "AD"]))
    page = "<article><p>" + "word " * 30 + "</p><section id='related-work'><p>Others</p></section><p class='notice-period'>A month</p></article><div id=comments><article class=comment>No</article></div>"
    assert ht.main_text(page).split("\n")[1:] == ["Others", "A month"]


LONG = "<p>" + "word " * 40 + "</p>"


def test_no_block_of_a_region_is_lost():
    for page in ["<div><h1>H</h1>{}<p>End.</p><p>Short two.</p><p>Yes.</p></div>", "<div class='site no-sidebar'><article><h1>H</h1>{}<p>End.</p><div><p>Short two.</p></div><div>Yes.</div></article></div>", "<div hidden>gone</div><article><h1>H</h1>{}</article><article>End.<section class='social-history'><p>Short two.</p></section><p>Yes.</article>"]:
        assert ht.main_text(page.format(LONG * 4)).split("\n") == ["H", *["word " * 39 + "word"] * 4, "End.", "Short two.", "Yes."]
    bold = "<b>" * 50
    assert ht.main_text(f"<article><p>{bold}one<div>two</div><p>three").split("\n") == ["one", "two", "three"]


def test_scores_decide(monkeypatch):
    """Link lists in plain containers, articles of links, and articles beside the text go by their scores alone."""
    links = "<ul>" + "".join(f"<li><a href=/{k}>Page {k}</a></li>" for k in range(8)) + "</ul>"
    pages = [f"<div>{links}</div><div>{LONG * 3}</div>", f"<article>{links}</article><article>{LONG * 3}</article>", f"<div>{LONG * 3}<p>Last.</p></div><article><a href=/>Teaser</a></article>", f"<nav>{links}</nav><article>{LONG}</article>"]
    want = ["\n".join(["word " * 39 + "word"] * n) for n in (3, 3, 3, 1)]
    want[2] += "\nLast."
    assert [ht.main_text(p) for p in pages] == want
    monkeypatch.setattr(ht, "scores", lambda lines: ht.np.ones(len(lines)))
    assert not any(ht.main_text(p) == w for p, w in zip(pages, want, strict=True))


def test_each_step_decides(monkeypatch):
    """Plain containers without a name: what stands out by its smoothed ratio is the region, and without any one step it is another."""
    menu = "<div>" + "".join(f"<p><a href=/{k}>Page {k}</a> <i>x</i> {'b' * k}</p>" for k in range(9)) + "</div>"
    page = f"{menu}<article><h1>Head</h1>{LONG}<p>Short.</p>{LONG}</article>{menu}"
    want = "\n".join(["Head", "word " * 39 + "word", "Short.", "word " * 39 + "word"])
    assert ht.main_text(page) == want
    with monkeypatch.context() as m:
        m.setattr(ht, "scores", lambda lines: ht.np.ones(len(lines)))
        assert "Page 3" in ht.main_text(page)
    with monkeypatch.context() as m:
        m.setattr(ht, "threshold", lambda values: -100.0)
        assert "Page 3" in ht.main_text(page)
    # a teaser of one long line stands out alone; smoothed, it is one of the short lines around it
    lone = "<div>" + f"<p><a href=/a>{'One ' * 12}</a></p>" * 6 + "<p>" + "tease " * 30 + "</p>" + f"<p><a href=/b>{'Two ' * 12}</a></p>" * 6 + "</div>"
    page = f"{lone}<div>{LONG * 4}</div>"
    assert ht.main_text(page) == "\n".join(["word " * 39 + "word"] * 4)
    with monkeypatch.context() as m:
        m.setattr(ht, "smoothed", lambda ratios: ratios)
        assert "tease" in ht.main_text(page)


def test_deep_nesting_is_linear():
    began = time.time()
    assert ht.main_text("<div><p>xx</p>" * 16_000).count("xx") == 16_000
    assert ht.main_text("<div>" * 16_000 + "</section></i>" * 16_000 + "x") == "x"
    assert time.time() - began < 4


def test_smoothing_and_threshold_by_hand():
    import math

    r = random.Random(11)
    for _ in range(50):
        x = [r.randrange(1, 400) for _ in range(r.randrange(1, 30))]
        k = {d: math.exp(-d * d / 2) for d in range(-3, 4)}
        hand = [sum(k[j - i] * x[j] for j in range(len(x)) if abs(j - i) <= 3) / sum(k[j - i] for j in range(len(x)) if abs(j - i) <= 3) for i in range(len(x))]
        assert ht.smoothed(ht.np.array(x, float)) == pytest.approx(hand)
        cut = ht.threshold(ht.np.array(hand))
        low, high = [v for v in hand if v <= cut], [v for v in hand if v > cut]
        assert high and (not low or cut == pytest.approx((sum(low) / len(low) + sum(high) / len(high)) / 2))


def random_page(r):
    """(page, its main text) of random nested blocks with random other parts around and between them."""
    words = lambda a, b: " ".join(r.choice(["alpha", "beta", "gamma,", "delta.", "é", "x"]) for _ in range(r.randrange(a, b)))
    other = lambda: r.choice([
        f"<nav><ul>{''.join(f'<li><a href=/x>{words(1, 3)}</a></li>' for _ in range(r.randrange(1, 9)))}</ul></nav>", f"<div class=ad>{words(3, 40)}</div>", f"<aside><h2>{words(1, 4)}</h2><p>{words(5, 60)}</p></aside>", f"<form><p>{words(2, 9)}</p><input name=q><button>Go</button></form>",
        f"<div id=comments><article class=comment><p>{words(5, 60)}</p></article></div>", f"<script>var x = '<p>{words(2, 9)}</p>';</script>", f"<style>p {{}}</style><!-- {words(1, 5)} -->", f"<div class='cookie-notice'><p>{words(5, 30)}</p></div>", f"<div role=complementary>{words(5, 30)}</div>", f"<div hidden>{words(5, 30)}</div>",
    ])
    out, blocks = [], []

    def block(depth):
        kind = r.choice(["p", "p", "p", "h2", "li", "quote", "cell", "div"]) if depth < 3 else "p"
        if kind == "div":
            out.append(r.choice(["<div>", "<section id='related-work'>", "<div class='has-sidebar'>"]))
            tag = re.match("<(\\w+)", out[-1])[1]
            for _ in range(r.randrange(1, 4)):
                block(depth + 1)
            out.append(f"</{tag}>")
            return
        text = words(1, 3) if r.random() < 0.3 else words(10, 120)
        blocks.append(text)
        raw = text.replace("é", r.choice(["&eacute;", "&#233;", "é"])).replace(" ", r.choice([" ", "  ", "\n\t"]), 2).replace("beta", r.choice(["<b>beta</b>", "<a href=/b>beta</a>", "beta"]), 2)
        out.append({"p": f"<p>{raw}" + r.choice(["</p>", ""]), "h2": f"<h2>{raw}</h2>", "li": f"<ul><li>{raw}</ul>", "quote": f"<blockquote><p>{raw}</p></blockquote>", "cell": f"<table><tr><td>{raw}</td></tr></table>"}[kind])

    for _ in range(r.randrange(2, 9)):
        block(0)
        if r.random() < 0.2:
            out.append(other())
    blocks.append(words(40, 90))
    out.append(f"<p>{blocks[-1]}</p>")
    a, b = r.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ("<div class='site right-sidebar'><article>", "</article></div>"), ("<div id=content>", "</div>")])
    page = "<html><head><title>t</title></head><body>" + "".join(other() for _ in range(r.randrange(4))) + a + "".join(out) + b + "".join(other() for _ in range(r.randrange(4))) + f"<footer>&copy; {words(1, 12)}</footer></body></html>"
    return page, "\n".join(blocks)


def test_random_pages():
    r = random.Random(5)
    for k in range(300):
        page, text = random_page(r)
        assert ht.main_text(page) == text, k


def test_a_very_long_page(spark):
    page = "<nav><a href=/>Home</a></nav><article>" + "<p>" + "x" * 2_000_000 + "</p>" + "<p>word</p>" * 50_000 + "</article>"
    got = ht.extract_pages(spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string")).collect()
    assert [r.n_chars for r in got] == [2_000_000 + 5 * 50_000] * 2


def test_pages(spark):
    rows = [(1, "u", PAGE.replace("{body}", "<article>" + ARTICLE + "</article>"), 1), (2, "u", None, 1), (3, None, "", 1), (None, "u", "<p>unclosed <b>bold", 1), (4, "u", "plain < text & more", 1), (5, "u", "<div>" * 3000 + "deep" + "</p>" * 10, 1), (6, "u", "<nav>only</nav>", 1)]
    got = ht.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [(r.page_id, r.url, r.text) for r in got] == [(1, "u", TEXT), (2, "u", ""), (3, None, ""), (None, "u", "unclosed bold"), (4, "u", "plain < text & more"), (5, "u", "deep"), (6, "u", "")]
    assert all(r.n_chars == len(r.text) for r in got)
    assert ht.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
