"""Plain functions of the operators against brute force and public libraries; no Spark."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from learnlens.llm import byte_bpe, html_text, langid, packing, pieces, quality, simhash, subspace, token_counts, url_filter

WORDS = [" ", "  ", "\n", "a", "bc", "é", "日本", "'s", "12", ".", "\t", " the", "▁", "<s>", "<|endoftext|>", "😀", "ing", "tion", "A", "\u0301", "   ", "\x1c", "\x85", "\r\n"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(n)] + ["", " ", "\n", "a" * 3000, "ab " * 300]


def test_byte_bpe_ids_are_those_of_tokenizers():
    encoder = byte_bpe.load(byte_bpe.default_path())
    library = Tokenizer.from_file(byte_bpe.default_path())
    texts = odd_texts(2000) + ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> <|endoftext|", "é <|endoftext|>\n\n日本<|ENDOFTEXT|>", "<|endof<|endoftext|>text|>"]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = encoder.encode(text)
        assert ids.tolist() == expected.ids, text
        assert encoder.sizes[ids].sum() == len(text.encode())


@pytest.mark.parametrize("unigram", [False, True])
def test_pieces_are_those_of_sentencepiece(tmp_path, unigram):
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_path(), "rb") as file:
        model.ParseFromString(file.read())
    if unigram:
        model.trainer_spec.model_type = pieces.UNIGRAM
        for piece in model.pieces:  # at -1e9 the library's own single-precision sums lose the rest
            piece.score = max(piece.score, -40_000)
    path = tmp_path / "model"
    path.write_bytes(model.SerializeToString())
    own, library = pieces.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = odd_texts(1500, 2) + ["the" * 500]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == library.decode(ids.tolist())
        assert own.decode(ids) == text or pieces.SPACE in text


def test_viterbi_is_the_best_sum():
    own = pieces.load(pieces.default_path())
    score = {t: float(s) for t, s in zip(own.texts, own.scores)}
    for word in ["▁the", "▁tionhend", "▁" + "anthe" * 6, "▁z日q"]:
        best = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(end):
                part = word[begin:end]
                value = score.get(part, float(own.unknown_score) if len(part) == 1 else -np.inf)
                best[end] = max(best[end], best[begin] + value)
        ids, _ = own.encode_words([word], pieces.UNIGRAM)
        got = sum(float(own.scores[i]) if i not in own.bytes_at.values() else 0 for i in ids)
        unknown = sum(c not in score for c in word)
        assert got + unknown * float(own.unknown_score) == pytest.approx(best[-1])


def test_token_spans_go_to_the_section_with_most_bytes():
    spans = np.array([[0, 4], [4, 5], [9, 12]])
    tokens = np.array([[0, 3], [3, 5], [3, 6], [5, 9], [8, 11], [0, 12]])
    section, crossing = token_counts.allocate(tokens[:, 0], tokens[:, 1], spans[:, 0], spans[:, 1])
    assert section.tolist() == [0, 0, 0, -1, 2, 0]
    assert crossing.tolist() == [False, True, True, False, True, True]
    assert token_counts.lines("é\n\nab") == [(0, 2), (2, 3), (3, 5)]
    assert token_counts.byte_places("é\nab", np.array([0, 2, 4])).tolist() == [0, 3, 5]


def test_fingerprint_by_hand():
    import xxhash

    text = "The Quick brown\tfox  JUMPS é"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) == expected
    assert simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint("a\xa0b c") == xxhash.xxh64_intdigest("a\xa0b c".encode(), 42)  # only ASCII white space parts words


def test_thresholds_add_up_and_cost_least():
    rng = np.random.default_rng(3)
    fps = rng.integers(-(2**63), 2**63 - 1, 500)
    for parts in (2, 3, 4):
        ones = simhash.unpacked(fps)
        both = ones.astype(float).T @ ones
        groups = simhash.group_bits(len(fps), both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        values = simhash.part_values(ones, groups)
        counts = {(i, j): np.bincount((values[:, i] >> j) & 255, minlength=256) for i, g in enumerate(groups) for j in range(0, len(g), 8)}
        near = simhash.candidates_by_distance(counts, groups, len(fps), 3)
        assert (simhash.allocate(values, groups, near, len(fps), 3).sum(axis=1) == 3 - parts + 1).all()


def test_packing_fills_and_keeps_everything():
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(1, 2048, 3000), np.full(500, 1100), rng.choice([700, 683, 665, 1024, 2048, 1], 2000), np.zeros(0, dtype=int)):
        bin_of, offset, fill = packing.pack_group(sizes, 2048)
        for b in set(bin_of.tolist()):
            own = np.flatnonzero(bin_of == b)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == (np.cumsum(sizes[own]) - sizes[own]).tolist()
            assert sizes[own].sum() == fill[own[0]] <= 2048
    bins = packing.pack_group(rng.integers(1, 1024, 3000), 2048)[0]
    assert len(set(bins.tolist())) > 0


def test_local_search_empties_bins():
    """Best fit leaves one bin more than needed; exchanges find the perfect packing."""
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])  # 30 tokens, three bins of 10
    start = [[0, 5], [1, 3], [2, 4], [6]]
    assert len(packing.local_search([list(b) for b in start], sizes, 10)) == 3
    assert packing.cuts(10, 4) == [0, 2, 6, 10] and packing.cuts(8, 4) == [0, 4, 8] and packing.cuts(3, 4) == [0, 3]


def test_ngram_ranks():
    grams, counts = langid.ngrams("Ab, ab")
    text = {"".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s & 0x1FFFFF): int(n) for g, n in zip(grams.tolist(), counts)}
    assert text == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}
    assert len(langid.ngrams("12 ,.")[0]) == 0 and len(langid.ngrams("")[0]) == 0


def test_out_of_place_distance():
    def profile(s):
        return langid.ngrams(s)

    p = langid.make_profiles({"x": profile("aaa bbb aaa"), "y": profile("ccc ddd")}, 50)
    assert p.predict("aaa bbb")[0] == "x" and p.predict("ddd")[0] == "y" and p.predict("123") == (langid.NONE, 0.0)
    own = langid.ranked(*langid.ngrams("aaa"), 50).tolist()
    base = langid.ranked(*langid.ngrams("aaa bbb aaa"), 50).tolist()
    expected = sum(abs(base.index(g) - i) if g in base else 50 for i, g in enumerate(own)) / (50 * len(own))
    assert p.distances("aaa")[0] == pytest.approx(expected)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    assert quality.fit(np.zeros((0, 16)), np.zeros(0)).scores(np.zeros((2, 16))).tolist() == [0.5, 0.5]
    assert quality.fit(x[:5], np.ones(5)).scores(x[:1])[0] > 0.5


@pytest.mark.parametrize("text", ["", "x", "!!", "\n\n", "a" * 10_000, "é" * 10])
def test_measures_are_finite(text):
    assert np.isfinite(quality.measures(text)).all() and len(quality.measures(text)) == len(quality.FEATURES)


PAGE = """<html lang=en><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice"><p>We use cookies and this is a long sentence that is in the notice of the site for all of you.</p></div>
<nav><ul><li><a href=x>Home</a></ul><main><article><header><h1>Title &amp; more</h1><p>By me</p></header>
<p>One <b>bold</b>text &lt;x&gt; and   the rest&nbsp;of it is here for you, a sentence which is long enough.<p>Short.<form><input><label>Name</label></form>
<table><tr><td>a<td>b</table><aside>Side</aside><div class="ad">Buy the thing that is in the shop and have it for ever and ever with this</div>
<section id="comments"><article class="comment"><p>I think that the article is wrong and it is the worst of all that I have read</p></article></section>
</article></main><footer>(c)</footer><foot"""


def test_page_with_article():
    assert html_text.main_text(PAGE) == "Title & more\nOne boldtext <x> and the rest of it is here for you, a sentence which is long enough.\nShort.\na\nb"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout-with-sidebar", "has-sidebar", "hasSidebar", "no-comments"])
@pytest.mark.parametrize("tag", ["main", "article", "div role=main"])
def test_page_in_a_layout_named_after_a_sidebar(name, tag):
    text = "The story of the man who was in the house and had no idea that it was on fire for a long time."
    end = tag.split()[0]
    side = '<div class="sidebar"><article><p>The other things that are in the bar at the side of the page and that you can read</p></article></div>'
    related = '<div class="related-posts"><article><p>The next story of the man who was in the house and that you can read</p></article></div>'
    assert html_text.main_text(f'<body><div class="{name}"><{tag}><h1>Head</h1><p>{text}</p></{end}>{side}</div></body>') == f"Head\n{text}"
    assert html_text.main_text(f"<body><{tag}><p>{text}</p></{end}>{related}</body>") == text


def test_page_without_article():
    page = """<div><a href=1>Home</a> <a href=2>News</a></div><h2>Heading</h2><div>The story of the man who was in the house and had no idea that it was on fire for a long time.</div>
    <p>Yes.</p><div><a>One</a><br><a>Two</a></div><div>Foo</div><div>""" + "zzz qqq " * 30 + "</div><p>Bar</p>"
    assert html_text.main_text(page).split("\n") == ["Heading", "The story of the man who was in the house and had no idea that it was on fire for a long time.", "Yes."]


def test_page_with_a_named_container():
    page = """<div id=wrap><div class="topnav"><a href=1>Home</a></div><div class="post-content"><h1>Head</h1><p>thanon | ndwhan | thingesth | haanntinged | eratst | eaersh | ention | theaen | ertio</p><p>x</p></div>
    <div class="side-bar sidebar"><p>The other things that are in the bar at the side of the page and that you can read</p></div>
    <ol class="commentlist"><li><div class="content"><p>I think that it is the worst of all of the things that I have read in my life so far</p></div></ol><div class=footer-content>All</div></div>"""
    assert html_text.main_text(page).split("\n") == ["Head", "thanon | ndwhan | thingesth | haanntinged | eratst | eaersh | ention | theaen | ertio", "x"]


def test_page_of_short_blocks_next_to_comments():
    page = """<div id="main"><h1>T</h1><p>The dog was in the house and it was not for us.</p><p>Short one.</p><div class="comments"><h3>Comments</h3>
    <p>I think that the dog was in the house and that it is a good thing for us to be in it.</p></div></div>"""
    assert html_text.main_text(page) == "T\nThe dog was in the house and it was not for us.\nShort one."


def test_links_of_an_article_stay_unless_they_are_a_list():
    page = "<main><p>The text.</p><p><a href=x>The whole report</a></p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></main>"
    assert html_text.main_text(page) == "The text.\nThe whole report"


def test_stop_words_of_long_and_middle_blocks():
    long, some, none = ("zzz qqq xxx yyy vvv of " * 12).strip(), "A block of some middle length: " + "qqq " * 14 + "zzz", ("zzz qqq " * 10).strip()
    assert len(long) >= html_text.LONG > len(some) and len(none) >= html_text.SHORT
    # Good; open, so it follows its neighbour; bad.
    assert html_text.main_text(f"<div>{long}</div><p>{some}</p><div>{none}</div>") == f"{long}\n{some}"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>Hi</p>", "Hi"), ("a < b &amp; c", "a < b & c"), ("<!-- x", ""), ("<p title='it>x", "x"), ("<article><p>A<p><b>B<br><p>C</article>", "A\nB\nC"), ("<" * 50, "<" * 50)])
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


def test_rules_longest_wins():
    trie = url_filter.Trie([("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "org", "/a/b"), ("allow", "com", "/x/"), ("block", "com", "/x/")])
    assert trie.find("a.example.org", "/es/1") == ("example.org/es/", "block")
    assert trie.find("a.example.org", "/en/123") == ("example.org/en/1", "block")
    assert trie.find("example.org", "/es") == ("org/", "allow")
    assert trie.find("x.org", "/a/bc/d") == ("org/a/b", "block")
    assert trie.find("org", "") is None and trie.find("xorg", "/") is None and trie.find("", "") is None
    assert trie.find("com", "/x/y") == ("com/x/", "block")
    with pytest.raises(ValueError):
        url_filter.Trie([("maybe", "x", "/")])


@pytest.mark.parametrize("leaf", [1, 500, 1 << 18])
def test_pairs_within_a_budget(monkeypatch, leaf):
    """Every pair once, whether sides are halved to the end or compared at once; a ball of rows that no axis splits."""
    monkeypatch.setattr(subspace, "LEAF", leaf)
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.standard_normal((250, 5)) * 0.4, 0.02 * rng.standard_normal((60, 5)), np.zeros((5, 5))]).astype(np.float32)
    budget = 0.06
    near = subspace._Near(y, budget)
    far = ((y[:, None].astype(float) - y[None]) ** 2).sum(axis=2)
    sure = {(i, j) for i, j in zip(*np.nonzero(far <= budget - 2e-5)) if i < j}
    may = {(i, j) for i, j in zip(*np.nonzero(far <= budget + 3e-5)) if i < j}
    got = [tuple(sorted(p)) for a, b in near.pairs(np.arange(len(y))) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and sure <= set(got) <= may and len(sure) > 1000
    left, right = np.arange(0, len(y), 2), np.arange(1, len(y), 2)
    got = [tuple(sorted(p)) for a, b in near.pairs(left, right) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and {p for p in sure if sum(p) % 2} <= set(got) <= {p for p in may if sum(p) % 2}


PROSE = "The dog was in the house of the man and it was not for us to say that he is on his own with all of it in the end."
MORE = "It is the one that we had on the way to the sea, and they were with us for most of the day and the night in the rain."


@pytest.mark.parametrize("section", ['<section id="discussion">', '<section id="related-work">', '<div class="social-history">', '<section class="sec" id="search-strategy">', '<section id="notice">'])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_sections_of_an_article_keep_their_text(tag, section):
    end = "section" if section.startswith("<section") else "div"
    page = f"<body><{tag}><h1>Head</h1><p>{PROSE}</p>{section}<h2>Part</h2><p>{MORE}</p></{end}></{tag}></body>"
    assert html_text.main_text(page) == f"Head\n{PROSE}\nPart\n{MORE}"


@pytest.mark.parametrize("name", ["comments", "reader-comments", "comment-list", "related-posts", "share-buttons", "newsletter-signup", "ad-slot"])
def test_bad_parts_of_an_article_go(name):
    page = f'<body><article><h1>Head</h1><p>{PROSE}</p><div class="{name}"><h2>Part</h2><p>{MORE}</p><p>{PROSE}</p></div></article></body>'
    assert html_text.main_text(page) == f"Head\n{PROSE}"


@pytest.mark.parametrize("wrapper", ['div class="layout-with-sidebar"', 'div class="container has-sidebar"', 'div class="page form-layout"', 'form id="aspnetForm" action="x"', 'div class="content-sidebar-wrap"', 'div class="widget"', 'form class="form"'])
def test_wrappers_of_a_whole_page_are_not_bad(wrapper):
    end = wrapper.split()[0]
    inner = f"""<nav><a href="/">Home</a></nav><h1>Head</h1><p>{PROSE}</p><p>{MORE}</p><div class="sidebar"><p>{MORE}</p></div><div class="comments"><p>{PROSE}</p></div><footer>&copy; us</footer>"""
    assert html_text.main_text(f"<body><{wrapper}>{inner}</{end}></body>") == f"Head\n{PROSE}\n{MORE}"
    notice = f'<p>Please note that the site is down for the night and that we are on it.</p><{wrapper}>{inner.replace("<h1>", "<article><h1>").replace("<div", "</article><div", 1)}</{end}>'
    assert html_text.main_text(f"<body>{notice}</body>") == f"Head\n{PROSE}\n{MORE}"


def test_items_next_to_links_stay():
    """In an article's list a link beside plain items is text; a list of links is not."""
    mixed = "<ul><li>Plain item</li><li><a href='x'>A linked item</a></li><li>Another one</li></ul>"
    menu = "<ul><li><a href='x'>One more</a></li><li><a href='y'>And more</a></li></ul>"
    assert html_text.main_text(f"<article><p>{PROSE}</p>{mixed}<p>{MORE}</p>{menu}</article>") == f"{PROSE}\nPlain item\nA linked item\nAnother one\n{MORE}"


def test_deep_pages_take_linear_time():
    import time

    for page in (
        "<div>" * 20_000 + f"<p>{PROSE}</p>" + "</i></li></td></p>" * 20_000,
        "<div class='sidebar'><li>" * 10_000 + "x" + "</div>" * 5_000 + "</div>" * 5_000 + f"<article>{PROSE}",
        "<i>" * 20_000 + f"<a>{PROSE}" + "</b>" * 20_000,
        "<p><b><tr><td><option>" * 4_000 + PROSE,
    ):
        began = time.perf_counter()
        assert PROSE in html_text.main_text(page) or "sidebar" in page or "<a>" in page
        assert time.perf_counter() - began < 1.5


def test_blocks_deep_inside_keep_their_links():
    """Headings and links count at any depth."""
    page = "<span>" * 6_000 + f"<article><h2>Head</h2><p>{PROSE}</p><ul><li><a>only a link</a></li><li><a>and another link</a></li></ul></article>"
    assert html_text.main_text(page) == f"Head\n{PROSE}"


def random_page(rng, depth=0):
    """Well-formed HTML, and the texts between block tags, None for a boundary."""
    html, parts = "", []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "inline", "block", "block"] if depth < 5 else ["text"])
        if kind == "text":
            raw, plain = rng.choice([("a &amp; b", "a & b"), (" x\n y ", " x\n y "), ("w&#233;", "wé"), ("&lt;p&gt;", "<p>"), ("  ", "  "), ("<!-- <p> no -->", ""), ("z", "z")])
            html, parts = html + raw, parts + [plain]
        else:
            tag = rng.choice(["b", "i", "span", "em"] if kind == "inline" else ["div", "section", "blockquote", "table", "h2"])
            inner, own = random_page(rng, depth + 1)
            # an inline element holds no block here, as their nesting is not well-formed
            if kind == "inline" and None in own:
                inner, own = "q", ["q"]
            html += f"<{tag} data-x='>'>{inner}</{tag.upper()}>"
            parts += own if kind == "inline" else [None, *own, None]
    return html, parts


def test_blocks_of_random_pages():
    rng = random.Random(5)
    for _ in range(400):
        html, parts = random_page(rng)
        expected, now = [], ""
        for part in [*parts, None]:
            if part is None:
                expected += [" ".join(now.split())] if now.split() else []
                now = ""
            else:
                now += part
        found, softs = html_text.blocks(html)
        assert [b.text for b in found] == expected and not softs
        assert not any(b.links or b.bad or b.item for b in found)


def test_tokens_of_sections_by_brute_force():
    """Each token by its characters' bytes: most bytes win, ties to the earlier section."""
    library = Tokenizer.from_file(byte_bpe.default_path())
    encoder = byte_bpe.load(byte_bpe.default_path())
    rng = random.Random(8)
    for text in odd_texts(300, 3) + ["日本語😀é" * 5, "naïve café\nzwei 😀\n\nthree<|endoftext|>\n four"]:
        size = len(text.encode())
        cuts = sorted(rng.sample(range(size + 1), min(size + 1, rng.randint(2, 7))))
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        owner = [next((k for k, (a, b) in enumerate(spans) if a <= i < b), -1) for i in range(size)]
        expected, crossing, at = [], [], 0
        for number in library.encode(text, add_special_tokens=False).ids:
            own = owner[at : at + int(encoder.sizes[number])]
            held = {k: own.count(k) for k in set(own) - {-1}}
            best = min(held, key=lambda k: (-held[k], k)) if held else -1
            expected.append(best)
            crossing.append(best >= 0 and held[best] < len(own))
            at += len(own)
        assert at == size
        sizes = encoder.sizes[encoder.encode(text)]
        ends = np.cumsum(sizes)
        begins, stops = (np.array([x[i] for x in spans], dtype=np.int64) for i in (0, 1))
        section, over = token_counts.allocate(ends - sizes, ends, begins, stops)
        assert section.tolist() == expected and over.tolist() == crossing


def plain_ngrams(text):
    """Words of letters, padded with one blank, in n-grams of 1 to 3 characters."""
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    grams = Counter()
    for word in folded.split():
        padded = f" {word} "
        grams.update(word)
        grams.update(padded[i : i + 2] for i in range(len(padded) - 1))
        grams.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return grams


def test_profiles_by_brute_force():
    """N-grams, ranks and distances counted in plain Python."""
    texts = {"en": "The cat, the dog and THE bird! Nobody's there; 3 of them.", "de": "Der Hund und die Straße, über-all ÄÖÜ. Der.", "x": "ß İ a1b c"}
    number = lambda gram: sum(ord(c) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))
    for text in [*texts.values(), *odd_texts(200, 6)]:
        got = dict(zip(*(x.tolist() for x in langid.ngrams(text))))
        grams = plain_ngrams(text)
        # between two words a gram spans one blank at most, as words are padded with one blank each
        assert {g: n for g, n in got.items() if g in set(map(number, grams))} == {number(g): n for g, n in grams.items()}
    profiles = langid.make_profiles({k: langid.ngrams(t) for k, t in texts.items()}, 20)
    order = lambda found: [g for g, _ in sorted(zip(*(x.tolist() for x in found)), key=lambda p: (-p[1], p[0]))][:20]
    for text in ["the dog und der", "xyz", "ß c a"]:
        own = order(langid.ngrams(text))
        for name, apart in zip(profiles.languages, profiles.distances(text)):
            ranks = order(langid.ngrams(texts[name]))
            assert apart == pytest.approx(sum(abs(i - ranks.index(g)) if g in ranks else 20 for i, g in enumerate(own)) / (len(own) * 20))


def test_trees_by_brute_force():
    """The best single cut, and the best cut on each of two features, among all of them."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        g, h = rng.standard_normal((6, 5)), rng.random((6, 5)) + 0.1
        worth = lambda gs, hs: gs.sum() ** 2 / (hs.sum() + 1.0)
        gain, table = quality._quarters(g, h, 1.0)
        best = max(
            (sum(worth(g[a, b], h[a, b]) for a in (slice(0, i), slice(i, 6)) for b in (slice(0, j), slice(j, 5))) - worth(g, h), i, j)
            for i in range(1, 6) for j in range(1, 5)
        )
        assert gain == pytest.approx(best[0])
        for a in (slice(0, best[1]), slice(best[1], 6)):
            for b in (slice(0, best[2]), slice(best[2], 5)):
                assert table[a, b] == pytest.approx(np.full(table[a, b].shape, -g[a, b].sum() / (h[a, b].sum() + 1)))
        one, other = g[0], h[0]
        cut = max(range(1, 5), key=lambda m: worth(one[:m], other[:m]) + worth(one[m:], other[m:]))
        leaves = quality._tree(one, other, 2, 1.0)
        if worth(one[:cut], other[:cut]) + worth(one[cut:], other[cut:]) > worth(one, other) + 1e-9:
            expected = np.repeat([-one[:cut].sum() / (other[:cut].sum() + 1), -one[cut:].sum() / (other[cut:].sum() + 1)], [cut, 5 - cut])
            assert leaves == pytest.approx(expected)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(9)
    x = rng.random((300, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    model = quality.fit(x, y, rounds=20, pair_rounds=5)
    for row, score in zip(x[:40], model.scores(x[:40])):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, at)) + sum(t[at[i], at[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.9
