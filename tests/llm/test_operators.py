"""Each operator against a brute-force version, the library it follows, or held-out accuracy; and its edge cases."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from larkspur.llm import byte_bpe, components, fingerprint, host_rules, html_text, minhash, mixing, rule_ensemble, suffix_tree, token_files, toxicity
from larkspur.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, row string"
RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a", "a b  c\td\ne", "ÀÉ ſtraße ΣΑΣ ﬁn", "x" * 300, "don't  stop \n\n now 12345 --!!", "日本語 テスト", "<|endoftext|> <|startoftext|>x", "é   \u0085  z", "the the the the the the"]


def texts(n=40, seed=3):
    """Random prose, copies, near copies, odd texts and one long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeiloßénst") for _ in range(r.randint(1, 7))) for _ in range(300)]
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randint(60, 160))) for _ in range(n)]
    out += [out[0]] * 6 + [out[1].replace(" ", "  ").upper()]
    for base in out[2:6]:
        for _ in range(4):
            words = base.split(" ")
            words[r.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return [*out, *ODD, " ".join(r.choice(vocabulary) for _ in range(30_000))]


@pytest.fixture(scope="module")
def rows():
    found = [(i * 7 % 1000, t, "en", ["a", "b", None][i % 3], None, 0.5, "k", "r") for i, t in enumerate(texts())]
    return [*found, found[3], (None, "no key at all", "en", "a", 1, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, rows, empty):
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs).collect()}
    share = Counter(r[3] or "" for r in rows)
    assert sum(rates[s] * n for s, n in share.items()) == pytest.approx(len(rows))

    def copies(key, rate):
        u, k, p = int(hashlib.md5(f"mix-1|{'' if key is None else key}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        return k

    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs, mixing.source_rates(docs)).collect())
    want = Counter()
    for r in rows:
        want[r[0], r[1]] += copies(r[0], rates[r[3] or ""])
    assert got == +want
    assert mixing.mix(empty, mixing.source_rates(empty)).count() == 0
    one = mixing.mix(docs, mixing.source_rates(docs, weights={"a": 1.0}, epochs=3.0))
    assert {r["source"] for r in one.collect()} == {"a"}
    with pytest.raises(ValueError):
        mixing.source_rates(docs, weights={"a": 0.0})


def test_poisson_mean_is_met(spark):
    large = spark.range(4000).selectExpr("id AS doc_id", "if(id < 3000, 'x', 'y') AS source")
    n = Counter(r["source"] for r in mixing.mix(large, mixing.source_rates(large, weights={"x": 1, "y": 3}, epochs=2)).collect())
    assert n["x"] == pytest.approx(2000, rel=0.08) and n["y"] == pytest.approx(6000, rel=0.08)


PAGES = [
    ("<p>a <b>b</b>c<p>d<br>e", "a bc\n\nd\ne"),
    ("<head><title>t</title><style>p{}</style></head><body>x<script>var a='</p>'</script>y", "xy"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>z", "- a\n- b\n  3. c\n  4. d\n\nz"),
    ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a   bbb\ncc  d"),
    ("<table><tr><th colspan=2>head<tr><td rowspan=2>r<td>1<tr><td>2</table>", "head\nr  1\n   2"),
    ("<div hidden>no</div><p style='display:none'>no</p><div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>", "yes"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("a < b &amp; c &lt;d&gt; <!-- x --> <![CDATA[q]]> e", "a < b & c <d> e"),
    ("<a title='>", ""),
    ("", ""),
    (None, ""),
    ("plain", "plain"),
    ("<textarea>in <b></textarea>", "in <b>"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<p class=it's>hello</p><p>world</p>", "hello\n\nworld"),
    ("<p>a</p><i ' ><p>b</p>", "a\n\nb"),
    ("a<!-->b</p>c<!--->d<!-- x --!>e", "ab\n\ncde"),
    ("<head><title>t</title>Hello", "Hello"),
    ("<math><mi>x</mi></math> <svg><title>t</title><desc>d</desc><text>label</text></svg>", "x label"),
    ("<a href=a=\"b>c", "c"),
    ("</3>x</>y", "xy"),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, p, "old") for i, (p, _) in enumerate(PAGES)], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAGES)}
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "x", "<table><tr><td>" * 3_000 + "x", "<ul><li>" * 2_000 + "x", "<a '" * 20_000, "<" * 50_000, "<p>" * 30_000 + "x", "<td colspan=99999>x" * 50])
def test_html_hostile(page):
    assert html_text.visible_text(page).count("x") <= 50


@pytest.mark.parametrize("part", ["<tr><td colspan=1000 rowspan=1000>x", "<p><td><span><div>", "<li><ul>", "<b><p '\">", "<!-- "])
def test_html_time_grows_with_length(part):
    import time

    def seconds(n):
        began = time.process_time()
        html_text.visible_text("<table>" + part * n)
        return time.process_time() - began

    seconds(200)
    assert seconds(4_000) < 40 * max(seconds(400), 0.01)  # ten times the length; a square would be a hundredfold


def test_html_keeps_every_letter():
    """The letters of random pages against those that Python's own HTML parser finds in the same order."""
    from html.parser import HTMLParser

    class Letters(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found = []

        def handle_data(self, data):
            self.found.append(data)

    r = random.Random(6)
    parts = ["<p>", "</p>", "<div class=a>", "</div>", '<b title="a>b">', "</b>", "<br/>", "<i data-x='q\"'>", "</i>", "<span hid=1>", "</span>", "&amp;", " ", "\n", "<h1>", "</h1>", "<blockquote>", "</blockquote>", "<pre>", "</pre>"]
    for _ in range(400):
        page = "".join(r.choice([*parts, "".join(r.choice("abcdé") for _ in range(3))]) for _ in range(r.randint(1, 60)))
        plain = Letters()
        plain.feed(page)
        plain.close()
        assert "".join(html_text.visible_text(page).split()) == "".join("".join(plain.found).split()), page


CLASHES = ["_mix_source", "_mix_cdf", "_html", "_text", "_toxic", "row", "key", "g", "u", "plain_mass", "copy"]


def test_clashing_names(spark):
    """Columns named like the operators' own come back, unless the docstring says that they are replaced."""
    texts_ = ["one two three four five six seven"] * 2 + ["", None]
    given = spark.createDataFrame([(i, t, t, "s", *["v"] * len(CLASHES)) for i, t in enumerate(texts_)], f"doc_id long, text string, html string, source string, {', '.join(f'{c} string' for c in CLASHES)}")
    for made in (
        mixing.mix(given, mixing.source_rates(given)),
        html_text.extract(given, into="html"),
        html_text.extract(given),
        byte_bpe.encode(given, RANKS, public_tokenizers.PATTERN),
        byte_bpe.encode(given, RANKS, public_tokenizers.PATTERN, into="text"),
        minhash.one_of_each(given),
        toxicity.scored(given, toxicity.ToxicityModel(("seven",), (1.0, 1.0, 1.0), -1.0)),
        rule_ensemble.scored(given, rule_ensemble.RuleModel((), 0.0)),
    ):
        rows_ = made.collect()
        assert all(r[c] == "v" for r in rows_ for c in CLASHES if c in made.columns and c != "copy")
        assert {"doc_id", "_mix_cdf", "row", "key"} <= set(made.columns)


def test_suffix_tree_words():
    texts = [b"", b" \n A b  C", b"x", b"", "\u00e9 \u00dcn\u00ef a\u0085b \x0bq".encode(), b"   ", b"y" * 40000, b"A b ab ba aab aba baa", b"1 " * 20000]
    coded = suffix_tree.Coded(texts)
    plain = [w for x in texts for w in (*x.translate(suffix_tree.LOWER_BYTES).split(), None)]
    assert coded.words(np.arange(len(coded.text))) == plain
    assert coded.all_words().to_pylist() == [w for w in plain if w is not None]
    hashes = dict(zip(plain, coded.hashes.tolist(), strict=True))
    assert coded.hashes.tolist() == [hashes[w] for w in plain] and len(set(hashes.values())) == len(hashes)
    for blank in ([], [b""], [b"", b" "]):
        coded = suffix_tree.Coded(blank)
        assert coded.sizes.tolist() == [1] * len(blank) and coded.all_words().to_pylist() == []


def test_suffix_tree(docs, rows, empty):
    got = sorted((tuple(r) for r in suffix_tree.fit_and_score(docs).collect()), key=repr)
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    words = lambda t: [w.decode() for w in (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()] + [None]
    counts = Counter(w for r in rows if not held(r[0]) for w in words(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((r[0], held(r[0]), len(words(r[1])), sum(w in counts for w in words(r[1])), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(r[1]))) for r in rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert sum(g[6] for g in got) > sum(g[5] for g in got)
    assert suffix_tree.fit_and_score(empty).count() == 0


def brute_scores(rows):
    """The suffix tree's scores by dictionaries over all contexts, with no bound on what is kept."""
    cut = lambda t: [*(t or "").encode().lower().split(), None]
    learned = [cut(t) for k, t in rows if zlib.crc32(str(k).encode()) % 10]
    grams = [Counter(tuple(w[i - d : i + 1]) for w in learned for i in range(d, len(w))) for d in range(suffix_tree.DEPTH + 1)]
    n, v = sum(grams[0].values()), len(grams[0])
    states = {}

    def share(context, symbol):
        if not context:
            return (grams[0][(symbol,)] + 0.1) / (n + 0.1 * (v + 1))
        if context not in states:
            return share(context[1:], symbol)
        left, listed = states[context]
        return listed[symbol] if symbol in listed else left * share(context[1:], symbol)

    for d in range(1, suffix_tree.DEPTH + 1):
        following = {}
        for g, k in grams[d].items():
            if k >= suffix_tree.MIN_COUNT:
                following.setdefault(g[:-1], {})[g[-1]] = k
        found = {}
        for context, listed in following.items():
            whole = grams[d - 1][context]
            if whole < suffix_tree.MIN_STATE:
                continue
            left = min(1.0, max(1e-9, 1 - sum(k - 0.75 for k in listed.values()) / whole))
            low = {w: share(context[1:], w) for w in listed}
            shares = {w: (k - 0.75) / whole + left * low[w] for w, k in listed.items()}
            if sum(k * math.log(shares[w] / low[w]) for w, k in listed.items()) + (whole - sum(listed.values())) * math.log(left) >= 20:
                found[context] = left, shares
        states.update(found)
    vocabulary = [g[0] for g in grams[0]]
    for context in [*states][:20]:  # distributions, with what is left for unknown words
        assert sum(share(context, w) for w in vocabulary) < 1 + 1e-9
    score = lambda w: sum(math.log10(share(tuple(w[max(0, i - suffix_tree.DEPTH) : i]), x)) for i, x in enumerate(w))
    return {k: score(cut(t)) for k, t in rows}, Counter(map(len, states))


@pytest.mark.parametrize("least", [None, 0.01])
def test_suffix_tree_keeps_what_is_rare(spark, monkeypatch, least):
    """A high share for the broadcast head, as in a large corpus, doesn't take states or entries from the tree."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeiloß") for _ in range(4)) for _ in range(200)]
    after, found = {}, []
    for i in range(60):
        words = vocabulary[:3]
        while len(words) < 100:
            next_ = after.setdefault(tuple(words[-3:]), r.choice(vocabulary[:6]))
            words.append(r.choice(vocabulary if r.random() < 0.1 else vocabulary[:6]) if r.random() < 0.3 else next_)
        found.append((i, " ".join(words)))
    found += [(100, ""), (101, "word"), (102, " ".join(vocabulary) + " never seen")]
    if least:
        for name in ("MIN_WORD", "MIN_ENTRY"):
            monkeypatch.setattr(suffix_tree, name, least)
    want, n_states = brute_scores(found)
    assert n_states[1] and n_states[suffix_tree.DEPTH] > 20
    got = {x["doc_id"]: x["score"] for x in suffix_tree.fit_and_score(spark.createDataFrame(found, "doc_id long, text string").repartition(3)).collect()}
    assert got == pytest.approx(want)


def test_suffix_tree_moves_codes_together(spark):
    """Codes of many grams are one row a part, about six bytes each; a document's codes are counted."""
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 200_000, dtype=np.uint64))
    n = np.ones(len(codes), dtype=np.uint32)
    moved = list(suffix_tree.dealt(codes, 4, n))
    assert [part for part, _, _ in moved] == list(range(16)) and sum(len(x) for *_, x in moved) < 7 * len(codes)
    back = [suffix_tree.unpacked(data, size, np.uint64, np.uint32) for _, size, data in moved]
    assert (np.concatenate([x[0].cumsum() for x in back]) == codes).all() and (np.concatenate([x[1] for x in back]) == n).all()
    assert list(suffix_tree.dealt(codes[:0], 4, n[:0])) == []
    got = suffix_tree.counted(np.array([5, 3, 5, 5], dtype=np.uint64), np.array([0, 0, 0, 1], dtype=np.uint32))
    assert [x.tolist() for x in got] == [[3, 5, 5], [0, 0, 1], [1, 2, 1]]
    bits = suffix_tree.bitmap(spark.createDataFrame([(int(x),) for x in codes[:1000].view(np.int64)], "g long"))
    assert suffix_tree.has_bit(bits, codes[:1000].view(np.int64)).all() and np.unpackbits(bits).sum() <= 1000


def test_suffix_tree_tells_contexts_of_one_tag_apart(spark, monkeypatch):
    r = random.Random(5)
    found = [(i, " ".join(r.choice("abcdefgh" if i % 2 else "aabbc") + r.choice("xy") for _ in range(150))) for i in range(60)]
    monkeypatch.setattr(suffix_tree, "TAG", 1)
    want, n_states = brute_scores(found)
    assert n_states[1] > 4
    got = {x["doc_id"]: x["score"] for x in suffix_tree.fit_and_score(spark.createDataFrame(found, "doc_id long, text string")).collect()}
    assert got == pytest.approx(want)


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    encoded = byte_bpe.encode(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    got = Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in encoded.collect())
    assert got == Counter((r[0], r[1], tuple(own.encode_ordinary(r[1] or ""))) for r in rows)
    back = Counter((r["doc_id"], r["text"], bytes(r["decoded"])) for r in byte_bpe.decode(encoded, RANKS).collect())
    assert back == Counter((r[0], r[1], (r[1] or "").encode()) for r in rows)
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(docs, rows, empty):
    import struct

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_files.round_trip(docs, WORDS).collect()), key=lambda x: x[0])
    want = sorted(((r[0], [*ids(r[1])]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g[1] for g in got] == [w[0] for w in want]
    start = 0
    for g, (_, tokens) in zip(got, want, strict=True):
        assert g[0] == start and g[2] * 4 == len(g[3])
        start += g[2]
        assert g[3] == struct.pack(f"<{len(tokens)}I", *tokens)
    assert token_files.round_trip(empty, WORDS).count() == 0


def test_token_files_marks_after_letters_that_come_apart():
    """Every letter before a mark, also those that the tokenizer turns into a letter and a combining mark."""
    import sys
    from array import array

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    units = ["YENİ,", "হয়,", "\u0958!", "\ufb2a.", "\u0b5c,", "été,", "Straße;"] + [chr(i) + "," for i in range(sys.maxunicode + 1) if chr(i).isalpha()]
    want = [array("H", [*x.ids, 2]).tobytes() for x in tokenizer.encode_batch_fast(units, add_special_tokens=False)]
    got = token_files.encode_block(WORDS, [x.encode() for x in units], 2, 2)
    assert [u for u, g, w in zip(units, got, want, strict=True) if g != w] == []


def test_token_files_look_units_up_once(monkeypatch):
    """New units leave places that are filled; memories take turns, and long units aren't kept."""
    from array import array

    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "MEMORY", 20)
    monkeypatch.setattr(token_files, "_TOKENIZERS", {})
    tokenizer, r = Tokenizer.from_file(WORDS), random.Random(2)
    for _ in range(12):
        block = ["", "  ", "y" * 100, *(" ".join(r.choice(["Word", "word,", "x1", "don't", "Straße;", "y" * 70, str(r.randrange(40))]) for _ in range(30)) for _ in range(4))]
        want = [array("H", [*tokenizer.encode(x, add_special_tokens=False).ids, 2]).tobytes() for x in block]
        assert token_files.encode_block(WORDS, [x.encode() for x in block], 2, 2) == want
        _, known, _ = token_files._TOKENIZERS[WORDS]
        assert known.open == {} and max(map(len, known)) <= token_files.LONGEST and set(map(type, known.values())) == {bytes}


def brute_components(rows, width):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(s), least.get(find(i)), r[0] == least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("width", [4, 5])
def test_minhash(docs, rows, width):
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs, width=width).collect()), key=repr) == brute_components(rows, width)


def test_minhash_one_of_each_and_empty(docs, empty):
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    a, b = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "0 1 2 3 4 5 6 7 8 9"
    rows_ = [(None, a), (None, a + " end"), (7, b), (7, a), (3, a + " last"), (None, None), (5, ""), (5, "")]
    got = minhash.one_of_each(docs.sparkSession.createDataFrame(rows_, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(7, b), (3, a + " last"), (None, None), (5, "")], key=repr)
    lone = docs.sparkSession.createDataFrame([(None, a), (None, a + " end")], "doc_id long, text string")
    assert minhash.one_of_each(lone).count() == 1
    assert kept.filter("doc_id IS NOT NULL").count() >= minhash.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_chain_of_near_copies(spark):
    """Each text differs from the one before, and the ends are far apart: one component through its middle."""
    words = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(40):
        chain.append((100 - i, " ".join(words)))
        words[(i * 5) % 200] = f"n{i}"
    got = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), width=4).collect()
    assert {r["component_id"] for r in got} == {61}


def near_copies(n, edits, seed=4, size=200):
    """Copies of one text, each with `edits` words of its own, far enough apart that each changes four shingles."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(size)]
    found = []
    for i in range(n):
        words = list(base)
        for k in r.sample(range(size // 5 - 1), edits):
            words[5 * k + 2] = f"own{i}x{k}"
        found.append((i, " ".join(words)))
    return found


@pytest.mark.parametrize("edits", [2, 5, 8])
def test_minhash_group_around_the_threshold(spark, monkeypatch, edits):
    """Copies that are all linked, just not linked, or far from it: links are exact, and few of all pairs are compared."""
    n, found = 300, near_copies(300, edits)
    counts, whole = [], minhash.compared
    monkeypatch.setattr(minhash, "compared", lambda pairs, *rest: counts.append(pairs.count()) or whole(pairs, *rest))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(found, "doc_id long, text string"), width=4).collect()}
    assert got == {r[0]: r[2] for r in brute_components(found, 4)}
    assert sum(counts) < 0.3 * n * (n - 1) / 2 and (len(counts) < 3 or counts[2] < 0.1 * n * (n - 1) / 2)


def test_minhash_recall_at_the_threshold():
    """Pairs of similarity 0.8 exactly: about 1 in 10,000 misses all bands."""

    circulant, r, missed = minhash.Circulant(), np.random.Generator(np.random.PCG64(3)), 0
    for size in (10, 50, 200):
        for _ in range(400):
            union = r.integers(0, 2**63, size, dtype=np.uint64)
            a, b = union[size // 10 :], union[: size - size // 10]
            buckets = circulant.buckets(np.stack([circulant.signature(a), circulant.signature(b)]))
            missed += not (buckets[0] == buckets[1]).any()
    assert missed <= 3


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5), (2000, 2000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprints(docs, rows, empty):
    def canonical(t):
        import re

        x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
        return re.sub(r"[\s\x1c-\x1f\x85]+", " ", x).strip()

    forms = {}
    for r in fingerprint.fingerprints(docs.select("doc_id", "text")).collect():
        forms.setdefault(r["fingerprint"], 0)
        forms[r["fingerprint"]] += 1
    assert sorted(forms.values()) == sorted(Counter(canonical(r[1]) for r in rows).values())
    assert fingerprint.fingerprints(empty).count() == 0 and fingerprint.compared(empty).count() == 0


def test_fingerprint_of_edited_text(spark):
    texts_ = [(i, t) for i, t in enumerate(["abc def ghi", "ABC  def ghi", "", None, "xyz" * 5, "é" * 9, "é" * 9] * 5)]
    got = {r["doc_id"]: r for r in fingerprint.compared(spark.createDataFrame(texts_, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(texts_, reverse=True, key=lambda x: x[0])
    for i, (key, t) in enumerate(order):
        following, t = order[(i + 1) % len(order)][1] or "", t or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        assert got[key]["n_chars"] == len(t)
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[key]["near_next"] == 1.0) == (got[key]["fingerprint"] == got[order[(i + 1) % len(order)][0]]["fingerprint"])
        assert (got[key]["near_edited"] == 1.0) == (got[key]["fingerprint"] == got[key]["edited_fingerprint"])
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[5]["fingerprint"] == got[6]["fingerprint"]


def brute_edits(word, term):
    row = list(range(len(term) + 1))
    for i, c in enumerate(word, 1):
        new = [i]
        for j, d in enumerate(term, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_lexicon_automaton():
    terms = ["idiot", "stupid", "disgusting", "vequ" + toxicity.OPEN, "lostra" + toxicity.OPEN, "f***"]
    automaton, r = toxicity.LexiconAutomaton(terms), random.Random(2)
    words = terms + ["stupd", "stuupid", "disgstng", "vequelle", "lostrx", "lotraxx", "", "s", "idio", "idiots", "friend", "fish", "f***", "f"]
    for t in terms:
        for _ in range(60):
            w = list(t.removesuffix(toxicity.OPEN))
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 1)] = r.choice(["", "x", "s"])
            words.append("".join(w) + r.choice(["", "", "zz"]))
    for w in words:
        best = -1
        for t in terms:
            letters = t.removesuffix(toxicity.OPEN)
            most = max((k for n, k in toxicity.EDITS if len(letters) >= n), default=0)
            heads = [w[:i] for i in range(len(w) + 1)] if t.endswith(toxicity.OPEN) else [w]
            near = min(brute_edits(h, letters) for h in heads)
            if near <= most and (best < 0 or near < best):
                best = near
        assert automaton.edits(w) == best, w


def labelled(n=400):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeilonst") for _ in range(r.randint(2, 8))) for _ in range(500)]
    found = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 120))]
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for w in ("stupid", "worthless", "idiot"):
                words[r.randrange(len(words))] = w
        found.append((i, " ".join(words), toxic, good))
    return found


def test_toxicity_held_out(spark):
    found = labelled()
    docs, labels = spark.createDataFrame([x[:2] for x in found] + [(9001, None), (9002, "you are so stuppid and worthles"), (None, "calm words")], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in found] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [x for x in found if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert all(got[x[0]]["held_out"] for x in held)
    assert sum(got[x[0]]["predicted"] == x[2] for x in held) >= 0.97 * len(held)
    assert got[9001]["predicted"] == 0 and got[9002]["predicted"] == 1 and got[None]["predicted"] == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_toxicity_held_out_by_language(spark):
    """Few labelled texts of a language teach its terms, however many there are of another."""
    r = random.Random(8)
    vocabulary = {lang: ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(150)] for lang, letters in (("en", "abcdeilonst"), ("es", "aeioñrmpzuj"))}
    insults, found = {"en": ["stupid", "worthless"], "es": ["imbécil", "basura"]}, []
    for i in range(1600):
        lang = "es" if i % 16 == 0 else "en"
        toxic = int(i % 320 == 0 if lang == "es" else i % 3 == 0)
        words = [r.choice(vocabulary[lang]) for _ in range(30)]
        if toxic:
            words[3], words[20] = insults[lang]
        found.append((i, " ".join(words), lang, toxic))
    learned = [x for x in found if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    assert 3 <= sum(x[2] == "es" and x[3] for x in learned) < 0.02 * sum(x[3] for x in learned)
    docs = spark.createDataFrame([x[:2] for x in found], "doc_id long, text string")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, spark.createDataFrame([(x[0], x[3]) for x in found], "doc_id long, toxic int")).collect()}
    for lang in ("en", "es"):
        for toxic in (0, 1):
            held = [x for x in found if got[x[0]]["held_out"] and x[2:] == (lang, toxic)]
            assert held and sum(got[x[0]]["predicted"] == toxic for x in held) >= 0.95 * len(held), (lang, toxic)


def test_training_rows_do_not_depend_on_order(spark):
    """A key with several texts teaches the least of them, however the rows are dealt."""
    found = [(i, t) for i in range(40) for t in (f"text {i} one two", f"another {i}", None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    for learned in (lambda d: rule_ensemble.training_rows(d, labels, label="label"), lambda d: toxicity.training_texts(d, labels, label="label")):
        taught = [sorted(map(tuple, learned(spark.createDataFrame(x, "doc_id long, text string").repartition(k)).collect())) for x, k in ((found, 1), (found[::-1], 7))]
        assert taught[0] == taught[1] and taught[0]
    rows_ = [rule_ensemble.training_rows(spark.createDataFrame(found, "doc_id long, text string").repartition(k), labels, label="label") for k in (1, 7)]
    assert rule_ensemble.fit(rows_[0]) == rule_ensemble.fit(rows_[1])


def test_rules_compile_to_what_they_say(spark):
    """The compiled column against the rules evaluated one by one on each row's statistics."""
    given = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    model = rule_ensemble.RuleModel(
        ((rule_ensemble.Rule((("log_words", 2.0, True), ("distinct_rate", 0.9, False))), 1.5), (rule_ensemble.Rule((("word_length", 3.5, True),)), -0.75), (rule_ensemble.Rule((("repeat_rate", 0.0, True), ("log_words", 9.0, False))), 0.5)), -0.25
    )
    stats = {r["row"]["doc_id"]: r for r in rule_ensemble.with_statistics(given).collect()}
    for r in rule_ensemble.scored(given, model).collect():
        margin = model.intercept
        for rule, weight in model.rules:
            if all((stats[r["doc_id"]][f] > t) == above for f, t, above in rule.tests):
                margin += weight
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)))


def test_quotation_counts_less():
    finder = toxicity.HitFinder(("stupid",))
    plain, quoted = finder.prepared(["you are stupid today", 'she said "they are stupid" and left'])
    assert finder.masses(plain)[0] > 1 and finder.masses(plain)[1] == 0
    assert finder.masses(quoted)[0] == 0 and 0 < finder.masses(quoted)[1] < 1


def test_quality_held_out(spark):
    found = labelled()
    docs, labels = spark.createDataFrame([(*x[:2], 0.1) for x in found] + [(9001, None, 0.1), (None, "", 0.1)], "doc_id long, text string, row double"), spark.createDataFrame([(x[0], x[3]) for x in found] + [(None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rule_ensemble.quality(docs, labels).collect()}
    held = [x for x in found if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert sum(got[x[0]]["predicted"] == x[3] for x in held) >= 0.97 * len(held)
    assert len(got) == len(found) + 2
    assert rule_ensemble.quality(docs.limit(0), labels).count() == 0


def test_host_rules(docs, rows, empty):
    got = host_rules.host_rules(docs).collect()
    assert len(got) == len(rows)

    def brute(t):
        t = t or ""
        w = t.encode().split()
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)

    stats = [(r[0], r[2] or "", *brute(r[1])) for r in rows]
    stats = [tuple(r[3] or "" if i == 1 else x for i, x in enumerate(s)) for s, r in zip(stats, rows, strict=True)]
    failed = [s[2] < 50 or 2 * s[6] > s[2] for s in stats]
    bad = [f or s[4] > s[2] or s[3] < 2 * s[2] or s[3] > 20 * s[2] for f, s in zip(failed, stats, strict=True)]
    hosts = {h: (sum(s[1] == h for s in stats), sum(b for s, b in zip(stats, bad, strict=True) if s[1] == h)) for h in {s[1] for s in stats}}
    n, mean = len(stats), sum(bad) / len(stats)
    between = sum(k * k / m for m, k in hosts.values()) / n - mean * mean - mean * (1 - mean) * len(hosts) / n
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    verdict = {h: (k + mean * strength) / (m + strength) <= 0.5 for h, (m, k) in hosts.items()}
    want = [(s[0], *s[2:], f, not f and verdict[s[1]]) for s, f in zip(stats, failed, strict=True)]
    assert sorted(((r["doc_id"], *(r[c] for c in host_rules.COUNTS), r["base_failed"], r["kept"]) for r in got), key=repr) == sorted(want, key=repr)
    assert host_rules.host_rules(empty).count() == 0


def test_words(spark):
    found = spark.createDataFrame([(t or "",) for t in ODD], "t string")
    assert [r[0] for r in found.select(words_of(found["t"])).collect()] == [[w.decode() for w in (t or "").encode().split()] for t in ODD]
