"""Operators against brute force on small documents with nulls, ties, copies and clashing names."""

import collections
import hashlib
import html
import os
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from cohortlens.llm import near_duplicates as nd
from cohortlens.llm import packing, quality, substrings, token_file, warc
from cohortlens.llm import toxicity as tox
from cohortlens.llm._tokens import Encoder, load, token_path
from cohortlens.llm.attribution import section_tokens
from cohortlens.llm.decontamination import contamination_report, decontaminate
from cohortlens.llm.extraction import blocks_of, main_text
from cohortlens.llm.quality import keep_clean, quality_report
from cohortlens.llm.toxicity import Grammar, clause_features, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_words long, id_a string"
SPACE = r"[^\x20\x09-\x0D]+"


def made(seed=3, n=60):
    """Texts with shared passages, exact and near copies, nulls, empty and very long ones."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["été", "ñandú", "漢字"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for k in range(0, n, 5):
        texts[k] = f"{texts[k]}\n{passage}  {texts[k + 1]}"
    texts[7] = texts[8]
    near = texts[10].split()
    near[3] = "changed"
    texts[11] = " ".join(near)
    texts += [None, "", "   \n ", "one", "a a a " * 60, "x " * 20_000, texts[3], texts[3]]
    rows = [(k, t, [None, "en", "de"][k % 3], [None, "s"][k % 2], 5, "z") for k, t in enumerate(texts)]
    return rows + [rows[2], (None, texts[4], None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


CLASHES = ("new_text", "rows", "empty", "again", "__spans", "__items", "stretches", "row", "kept", "n_words", "level_keys", "fit", "set_id", "id_b")


def clashing(df):
    """df with columns named like what operators add."""
    return df.withColumns({c: F.concat(F.lit(f"own {c} of "), "doc_id") for c in CLASHES})


def rest_of(df):
    """Rows without their texts, counted."""
    return collections.Counter(map(tuple, df.select(*(F.col(f"`{c}`") for c in df.columns if c != "text")).collect()))


def table_of(scale, name):
    """The path of a table of the test data, beside that of BENCH_SF_DIR; without it the test is skipped."""
    base = os.path.dirname(os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/"))
    path = f"{base}/{scale}/{name}.parquet"
    if not os.path.exists(path):
        pytest.skip(f"no {path}")
    return path


def words(t):
    return re.findall(SPACE, t or "")


def test_substrings(docs, empty):
    rows = made()
    found = collections.Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r[1])] for i in range(len(w) - 34))
    want = []
    for r in rows:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 34):
            if found[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert collections.Counter(map(tuple, substrings.substring_report(docs).collect())) == collections.Counter(want)
    assert substrings.substring_report(empty).count() == 0
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns and rest_of(out) == rest_of(docs)
    left = collections.Counter((x[0], x[3]) for x in want if x[2])
    texts = collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect() if r.text is not None)
    assert not left - texts and substrings.without_repeats(empty).count() == 0
    assert substrings.without_repeats(clashing(docs)).columns == clashing(docs).columns


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_equal_windows_have_equal_anchors(letters):
    rng = random.Random(letters)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"[:letters]) for _ in range(rng.randrange(0, 150))) for _ in range(15)]
    texts[4] = texts[3] + " q " + texts[2]
    x, names = substrings.Anchors(pa.array(texts)), collections.defaultdict(set)
    n = 0
    for d, f, s, key in zip(x.doc, x.first, x.size, x.key, strict=True):
        for j in range(f, f + s):
            names[tuple(texts[d].split()[j : j + 35])].add(int(key))
            n += 1
    assert n == sum(max(0, len(t.split()) - 34) for t in texts) and all(len(v) == 1 for v in names.values())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_the_whole(name):
    texts = ["", "  a  b", "a\n b", " x", "x ", "a <|endoftext|> c", "it's  12 345,a", "a\n\nb c\n", None, "\x01 a \x01", "don't 'Re ﬁ É", "漢字 a \n b", *(r[1] for r in made())]
    ids, at = Encoder(token_path(name)).encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == load(token_path(name)).encode(t or "", add_special_tokens=False).ids


def test_token_file(docs, empty):
    got = token_file.token_files(docs, token_path("byte_bpe_50k.json")).collect()
    start, want = 0, []
    for r in sorted(made(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*load(token_path("byte_bpe_50k.json")).encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_file.token_files(empty, token_path("byte_bpe_50k.json")).count() == 0


def test_random_access():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32) >> np.random.default_rng(2).integers(0, 20, 5000).astype(np.uint32)
    file = token_file.TokenFile(token_file.encode_file([1], np.array([0, 5000]), ids))
    where = np.random.default_rng(3).integers(0, 5000, 900)
    assert (file.get(where) == ids[where]).all() and (file.document(0) == ids).all()


def test_decontamination(spark, docs, empty):
    rows = made()
    items = [("i1", " ".join(words(rows[0][1])[2:20])), ("i2", "one"), ("i3", None), ("i4", "w1 w2"), ("i5", "..."), ("i1", rows[9][1]), (None, rows[13][1].upper())]
    bench = spark.createDataFrame(items, "item_id string, text string")
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for name, t in items:
        w = plain(t)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[i : i + min(10, len(w))])].add(str(name or "null"))
    want = []
    for r in rows:
        w, hit, names = plain(r[1]), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    names |= windows[tuple(w[i : i + k])]
        want.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert collections.Counter(map(tuple, contamination_report(docs, bench).collect())) == collections.Counter(want)
    assert contamination_report(empty, bench).count() == 0
    kept = decontaminate(docs, bench, max_coverage=0.9)
    assert kept.columns == docs.columns and kept.count() < docs.count() and not rest_of(kept) - rest_of(docs)
    odd = decontaminate(clashing(docs), bench, max_coverage=0.9)
    assert odd.columns == clashing(docs).columns and odd.count() == kept.count() and not rest_of(odd) - rest_of(clashing(docs))
    assert decontaminate(empty, bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert collections.Counter(decontaminate(docs, bench, max_words=20).select("text").collect()) == collections.Counter(decontaminate(docs, bench).select("text").collect())


def test_near_duplicates(docs, empty):
    rows = made()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(r[1])) else set() for r in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                p, q = root[a], root[b]
                root = [q if x == p else x for x in root]
    least = {x: min((rows[k][0] for k in range(len(rows)) if root[k] == x and rows[k][0] is not None), default=None) for x in root}
    want = collections.Counter((r[0], least[x], n) for r, x, n in zip(rows, root, links, strict=True))
    assert collections.Counter(map(tuple, nd.near_duplicates(docs).collect())) == want
    assert nd.near_duplicates(empty).count() == 0
    kept = nd.one_of_each(docs)
    assert not rest_of(kept) - rest_of(docs) and nd.one_of_each(empty).count() == 0
    odd = nd.one_of_each(clashing(docs))
    assert odd.columns == clashing(docs).columns and odd.count() == kept.count() and not rest_of(odd) - rest_of(clashing(docs))
    no_words = sum(not s for s in sets)
    assert kept.columns == docs.columns and kept.count() == no_words + len({x for x, s in zip(root, sets, strict=True) if s})


def joined_by(ties):
    """The root of each end of ties (a, b)."""
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in ties:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    return top


def planted(base_share, pairs, seed=11):
    """Samples of pairs of just similar classes, all of which agree with one base in a share of orders."""
    r = np.random.default_rng(seed)
    base, rows = r.integers(1 << 16, size=nd.SAMPLES), []
    for p in range(pairs):
        own = np.where(r.random(nd.SAMPLES) < base_share, base, r.integers(1 << 16, size=nd.SAMPLES))
        other = np.where(r.random(nd.SAMPLES) < 0.8, own, r.integers(1 << 16, size=nd.SAMPLES))
        rows += [(2 * p, own.astype("<u2").tobytes()), (2 * p + 1, other.astype("<u2").tobytes())]
    return rows


@pytest.mark.parametrize(("base_share", "pairs"), [(0.95, 400), (0.75, 1200), (0.0, 400)])
def test_pairs_meet_in_split_nodes(spark, base_share, pairs):
    """Pairs that are just similar enough, in groups whose nodes split to some depth or are heavy."""
    classes = nd.written(spark.createDataFrame(planted(base_share, pairs), "set_id long, sample binary"))
    top = joined_by(map(tuple, nd._ties(classes).collect()))
    lost = sum(top(2 * p) != top(2 * p + 1) for p in range(pairs))
    assert lost <= 1, f"{lost} of {pairs} pairs never met"
    if not base_share:
        assert len({top(2 * p) for p in range(pairs)}) > 0.99 * pairs


def test_recall_among_half_similar_texts(spark):
    """4,000 texts that share half of their shingles and 400 planted pairs just similar enough, against brute force."""
    r = random.Random(21)
    common = [f"c{k}" for k in range(60)]
    rows, pairs = [], []
    for k in range(4000):
        rows.append((k, " ".join(common + [f"w{r.randrange(10**6)}" for _ in range(56)])))
    for k in range(400):
        words_ = rows[r.randrange(4000)][1].split()
        at = r.randrange(62, len(words_) - 12)
        words_[at], words_[at + 5] = "x", f"y{k}"
        rows.append((4000 + k, " ".join(words_)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    by = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            if x[-1][0] != "c":
                by[x].append(k)
    links = collections.Counter()
    for a, b in {(a, b) for x in by.values() for a in x for b in x if a < b}:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            pairs.append((a, b))
    got = {x.doc_id: x for x in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a].class_id == got[b].class_id for a, b in pairs)
    print(f"recall {found} of {len(pairs)}")
    assert len(pairs) > 300 and found >= 0.99 * len(pairs) and sum(x.n_links for x in got.values()) >= 0.99 * sum(links.values())


def test_blocks_give_the_same_links(docs, monkeypatch):
    want = collections.Counter(map(tuple, nd.near_duplicates(docs).collect()))
    monkeypatch.setattr(nd, "BLOCK_SETS", 2)
    assert collections.Counter(map(tuple, nd.near_duplicates(docs).collect())) == want


def test_warc(spark):
    pages = [(1, "http://a/x y", "<p>é" * 30), (2, None, "<p>é" * 30), (0, "u", "short"), (3, "u", "short"), (4, "u", None), (5, "v", "漢\r\n\r\n" * 40_000), (None, "w", "<p>é" * 30), (1, "dup", "<p>é" * 30)]
    got = collections.Counter(map(tuple, warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()))
    want = collections.Counter()
    for page_id, _, page in pages:
        blob = (page or "").encode()
        again = page == pages[0][2] and page_id != 1
        want[(page_id, len(blob), hashlib.sha256(blob).hexdigest(), "revisit" if again else "response", 1 if again else None)] += 1
    assert got == want
    named = [("a:b", "u", "<p>1</p>" * 20), ("null", "u", "x"), ("é /", "u", "<p>1</p>" * 20), (None, "u", "y")]
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(named, "page_id string, url string, html string")).collect()}
    assert found == {("a:b", "response", None), ("null", "response", None), ("é /", "revisit", "a:b"), (None, "response", None)}
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction(spark):
    page = "<html><head><title>t</title></head><body><header>top</header><nav><div><a>m</a></div></nav><div class='cookie-notice'>c<div>d</div></div><article><h1>H &amp; h</h1><p>a <b>b</b><br>c</p>tail<div id=ad-1>x</div><aside>s</aside><form>f</form><!-- n --></article><div class=comments><article><p>no</p></article></div><footer>f</footer>"
    assert blocks_of(page)[0] == ["H & h", "a b c", "tail"]
    shared = "<div>all of these words stand on every page of the host here</div>"
    rows = [(k, "http://h/x", f"<body>{shared}<div>{k}th own words only</div></body>") for k in range(3)] + [(7, None, None), (8, "http://h/x", ""), (9, "q", page), (9, "q", page)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = collections.defaultdict(list)
    for r in got:
        texts[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[1] == ["1th own words only"] and texts[7] == [""] and texts[8] == [""] and texts[9] == ["H & h\n\na b c\n\ntail"] * 2


ODD_PAGES = [
    ("<article><h1>T</h1><p class=ad>x<p>one<p>two</article>", ["T", "one", "two"]),
    ("<article><div class='entry-header'><h1>Title</h1></div><p>body</p></article>", ["Title", "body"]),
    ("<article><div class=header><h1>Title</h1></div><section aria-label='Related work'><p>w</p></section><p class='notice period'>n</p></article>", ["Title", "w", "n"]),
    ("<article><p title='it's'>q</p><p title=\"a>b\">r</p></article>", ["q", "r"]),
    ("<article><ul><li class=share>s<li>a<li>b</ul><p>c</article><p>d", ["a", "b", "c"]),
    ("<article><table><tr><td>a<td class=ad>x<td>b<tr><td>c</table></article>", ["a", "b", "c"]),
    ("<nav><ul><li>m<article><p>t</p></article>", ["t"]),
    ("<nav>m<article>teaser</article></nav><article>t</article>", ["t"]),
    ("<form><article>t</article></form>", ["t"]),
    ("<head><title>x</title><article>t<span class=ad>u<span>v</span>w</span> z</article>", ["t z"]),
    ("<article>a</div></div><p>b &lt;c&gt; &eacute;&nbsp;d</p></article>", ["a", "b <c> é d"]),
    ("<div class='site-header'>h</div><main><p>m</p></main><div class='ad-1'>x</div>", ["m"]),
    ("<article><script>if (a < b) '</p>'</script><p>1 < 2</p><style>p{}</style></article>", ["1 < 2"]),
]


@pytest.mark.parametrize(("page", "want"), ODD_PAGES)
def test_blocks_of_odd_pages(page, want):
    article, main, _ = blocks_of(page)
    assert (article or main) == want


def test_given_pages(spark):
    """Pages of the test data against a plain reading of their one article."""
    rows = spark.read.parquet(table_of("sf0.001", "pages"))
    got = {r.page_id: r.text for r in main_text(rows).collect()}
    for r in rows.collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = (re.sub("<[^>]*>", "", re.sub("<br>", " ", x)) for x in re.split("</?(?:p|h1)>", body))
        assert got[r.page_id] == "\n\n".join(y for x in parts if (y := " ".join(html.unescape(x).split())))


def test_copied_pages_count_once(spark):
    """Two copies of an open page don't make each other's own words boilerplate."""
    shared = "<div>all of these words stand on every page of the host here</div>"
    own = lambda k: " ".join(f"own{k // 2}x{j}" for j in range(12))
    rows = [(k, "http://h/x", f"<body>{shared}<div>{own(k)}</div>") for k in range(6)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == own(r.page_id) for r in got) and len(got) == 6


def word_ids(text, end=0):
    return [*load(token_path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, end]


def test_packing(docs, empty):
    rows, size = made(), 256
    want = collections.Counter()
    for r in rows:
        ids = word_ids(r[1])
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            want[(r[0], k // size, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    for per_shard in (packing.PER_SHARD, 20):
        got = packing.packed(docs, token_path("word_bpe_49k.json"), size=size, per_shard=per_shard).toPandas()
        assert collections.Counter(tuple(None if x != x else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
        shards = -(-(got.length < size).sum() // per_shard)
        assert got.sequence_id.nunique() <= -(-got.length.sum() // size) + shards
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= size
    assert packing.packed(empty, token_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_sections(docs, empty, rule):
    """Sections and their tokens from the tokenizer's own offsets."""
    tokenizer, want = load(token_path("byte_bpe_50k.json")), collections.Counter()
    for r in made():
        text = r[1] or ""
        lines = text.splitlines(keepends=True) if text.count("\n") else [text]
        edges = [0]
        for x in lines:
            edges.append(edges[-1] + len(x.encode()))
        found, crossing = [0] * len(lines), [0] * len(lines)
        byte = [len(c.encode()) for c in text]
        at = [0, *np.cumsum(byte).tolist()]
        done = 0
        for k, (a, b) in enumerate(tokenizer.encode(text, add_special_tokens=False).offsets):
            ids = tokenizer.encode(text, add_special_tokens=False).ids if k == 0 else ids
            n = len(tokenizer.id_to_token(ids[k]))
            first, last = done, done + n - 1
            assert at[a] <= first and last < at[b]
            done += n
            place = lambda x: int(np.searchsorted(edges, x, "right")) - 1
            one, two = place(first), place(last)
            share = {s: min(last + 1, edges[s + 1]) - max(first, edges[s]) for s in range(one, two + 1)}
            own = {"start": one, "end": two, "most": max(share, key=lambda s: (share[s], -s))}[rule]
            found[own] += 1
            crossing[own] += one != two
        for k, (x, n, c) in enumerate(zip(lines, found, crossing, strict=True)):
            want[(r[0], k, edges[k], len(x.encode()), n, c)] += 1
    assert collections.Counter(map(tuple, section_tokens(docs, token_path("byte_bpe_50k.json"), rule).collect())) == want
    assert section_tokens(empty, token_path("byte_bpe_50k.json"), rule).count() == 0


def counts_of(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by plain Python."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    places = collections.defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {i + k for own in places.values() if len(own) > 1 for i in own for k in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, empty):
    want = collections.Counter((r[0], *counts_of(r[1])) for r in made())
    got = quality_report(docs)
    assert collections.Counter(map(tuple, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())) == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.n_words is not None
        assert not (r.base_failed and r.kept)
    kept = keep_clean(docs)
    assert kept.columns == docs.columns and not rest_of(kept) - rest_of(docs)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in got.collect() if r.kept)
    odd = keep_clean(clashing(docs))
    assert odd.columns == clashing(docs).columns and not rest_of(odd) - rest_of(clashing(docs)) and odd.count() == kept.count()
    assert quality_report(empty).count() == 0 and keep_clean(empty).count() == 0


def low_median(x):
    """The value of rank ceil(n / 2)."""
    return np.sort(x, axis=0)[(len(x) - 1) // 2]


def plain_fits(groups, n_words, features, least_group):
    """A fit per group with enough documents: middle, mean, inverse covariance and scale."""
    floors = np.array([quality.FLOORS[a] for a in quality.FEATURES])
    widened = lambda c: c + np.diag(floors**2)
    d2 = lambda x, m, c: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
    state, own = {}, {}
    for key, rows in groups.items():
        if len(rows) < least_group:
            continue
        x = features[rows]
        q = low_median(x)
        x = q + (x - q) * np.sqrt(n_words[rows] / (n_words[rows] + quality.PULL))[:, None]
        spread = np.maximum(low_median(abs(x - q)) * 1.4826, floors)
        z = (x - q) / spread
        signs = z / np.maximum(np.sqrt((z * z).sum(1)), 1e-9)[:, None]
        own[key] = q, x
        for start, shape in (("medians", np.eye(len(q))), ("signs", signs.T @ signs / len(x)), ("squashed", np.tanh(z).T @ np.tanh(z) / len(x))):
            state[key, start] = q, widened(shape * np.outer(spread, spread)), None
    for step in range(quality.MAX_STEPS):
        fell = []
        for (key, start), (m, c, last) in state.items():
            x = own[key][1]
            d = d2(x, m, c)
            x = x[d <= low_median(d)]
            c = widened(np.cov(x.T, bias=True))
            det = np.linalg.slogdet(c)[1]
            fell.append(last - det if step else np.inf)
            state[key, start] = x.mean(0), c, det
        if max(fell, default=0) < quality.SETTLED:
            break
    out = {}
    for key, (q, x) in own.items():
        _, (m, c, _) = min(((state[key, s][2], s), state[key, s]) for s in quality.STARTS)
        out[key] = q, m, c, max(low_median(d2(x, m, c)) / quality.CHI2_MEDIAN, 1.0)
    return out


def plain_features(t):
    """n_words and the features of a text."""
    t = t or ""
    n, chars = len(words(t)), max(1, sum(map(len, words(t))))
    kinds = collections.Counter(unicodedata.category(c) for c in t)
    letters = sum(k for c, k in kinds.items() if c[0] == "L")
    return n, (sum(c in quality.SYMBOLS for c in t) / max(1, n)) ** 0.5, np.log(max(1.0, chars / max(1, n))), (kinds["Lu"] / max(1, letters)) ** 0.5, (max(0, sum(map(len, words(t))) - letters) / chars) ** 0.5


def plain_verdicts(rows, least_group):
    """Of rows with text, lang and source: (distance, kept) of each and the number of fits."""
    table = np.array([plain_features(r.text) for r in rows], float)
    n_words, features = table[:, 0], table[:, 1:]
    groups = collections.defaultdict(list)
    levels = [[(r.lang, r.source), (r.lang,), ()] for r in rows]
    for k, keys in enumerate(levels):
        for key in keys if n_words[k] >= 10 else ():
            groups[key].append(k)
    fits, out = plain_fits(groups, n_words, features, least_group), []
    for k, r in enumerate(rows):
        fit, distance = next((fits[x] for x in levels[k] if x in fits), None), 0.0
        if fit:
            q, m, c, scale = fit
            x = q + (features[k] - q) * np.sqrt(n_words[k] / (n_words[k] + quality.PULL)) - m
            distance = float(np.sqrt(x @ np.linalg.inv(c) @ x / scale))
        again = counts_of(r.text)[-1]
        out.append((distance, n_words[k] >= 10 and 100 * again <= 20 * n_words[k] and distance <= quality.CUT))
    return out, len(fits)


@pytest.mark.parametrize("least_group", [10, 60, 1000])
def test_verdicts_of_given_documents(spark, least_group):
    """Distances and verdicts against a plain search for the least determinant, exact medians included."""
    docs = spark.read.parquet(table_of("sf0.001", "documents"))
    rows = docs.collect()
    want, n_fits = plain_verdicts(rows, least_group)
    got = {r.doc_id: r for r in quality_report(docs, least_group=least_group).collect()}
    for r, (distance, kept) in zip(rows, want, strict=True):
        assert (got[r.doc_id].distance or 0) == pytest.approx(distance, rel=1e-6) and got[r.doc_id].kept == kept
    assert n_fits > 3 if least_group == 10 else (n_fits == 0) == (least_group == 1000)


def test_small_groups_use_their_language(spark):
    """Documents of a source below the least size are judged by the fit of their language."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9)) for _ in range(90))
    rows = [(k, text(), "en", "big") for k in range(150)] + [(150 + k, text(), "en", "small") for k in range(40)]
    statistics = quality.written(quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    keys = lambda least: {r.group_key.split(":")[0] for r in quality.fits(statistics, least).collect()}
    n = lambda least: quality.fits(statistics, least).where("group_key like '0:%'").count()
    assert n(60) == 1 and n(40) == 2 and keys(60) == {"0", "1", "2"}


def test_the_least_determinant_wins(spark):
    """Of a group with a tight cluster of outliers the fit is that of the start with the least determinant."""
    rng = np.random.default_rng(5)
    good = rng.normal(0, 1, (240, 4)) @ np.array([[1, 0.8, 0, 0], [0, 0.6, 0, 0], [0, 0, 1, 0.5], [0, 0, 0, 0.8]])
    bad = rng.normal(6, 0.3, (90, 4))
    rows = [("en", "s", 1000, *map(float, r)) for r in np.vstack([good, bad])]
    fit = quality.fits(spark.createDataFrame(rows, "lang string, source string, n_words long, " + ", ".join(f"{c} double" for c in quality.FEATURES))).where("group_key like '0:%'").first()
    means = np.array([fit[f"m_{c}"] for c in quality.FEATURES])
    assert np.abs(means).max() < 0.5 and fit.start in quality.STARTS and fit.log_determinant < np.log(np.linalg.det(np.cov(np.vstack([good, bad]).T)))


def test_outliers_go(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rng.randrange(9)) for _ in range(90)), "en", "s") for k in range(200)]
    rows += [(200 + k, " ".join(f"{rng.randrange(10**6)}%%%" for _ in range(90)), "en", "s") for k in range(20)]
    got = quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id < 200) for r in got)


def marks(classes, gaps):
    return dict(zip(tox.MARKS, clause_features(classes, gaps), strict=True))


def test_composed_transducers():
    i, t, you, no, said = tox.INSULT, tox.THREAT, tox.TARGET, tox.NEGATION, tox.REPORT
    one = lambda classes, gaps=None: {k for k, v in marks(classes, gaps or [0] * len(classes)).items() if v}
    assert one([i]) == {"insult"} and one([you, i]) == one([i, you]) == {"aimed"}
    assert one([t]) == set() and one([t, you]) == one([you, t]) == {"threat"}
    assert one([no, i], [0, 2]) == {"negated"} and one([no, i], [0, 3]) == {"insult"}
    assert one([said, you, i]) == {"told"} and one([i, said]) == {"insult"} and one([no, said, i]) == {"negated"}
    assert marks([you, i, i, no, i], [0] * 5) == {"insult": 0, "aimed": 2, "threat": 0, "negated": 1, "told": 0}


def plain_marks(clause):
    """MARKS of one clause (a list of classes), by what stands before and beside each word."""
    out = collections.Counter()
    aimed = tox.TARGET in clause
    for k, c in enumerate(clause):
        if c == tox.INSULT or (c == tox.THREAT and aimed):
            mark = "threat" if c == tox.THREAT else "aimed" if aimed else "insult"
            if tox.NEGATION in clause[max(0, k - tox.REACH) : k]:
                mark = "negated"
            elif tox.REPORT in clause[:k]:
                mark = "told"
            out[mark] += 1
    return out


def plain_toxic_features(text, units):
    """FEATURES of a text, word by word."""
    kinds = ((tox.INSULTS, tox.INSULT), (tox.THREATS, tox.THREAT), (tox.REPORTS, tox.REPORT), (tox.NEGATIONS, tox.NEGATION), (tox.TARGETS, tox.TARGET))
    pieces = regex.split(r"[^\p{L}'.]+", re.sub(r"[.!?;:\n]+", " . ", (text or "").lower()))
    starts = {u[2:]: u[0] for u in units if u[0] != "w"}
    doubtful = collections.defaultdict(set)

    def kind(w):
        if "w:" + w in units:
            return tox.INSULT
        if found := [k for group, k in kinds if w in group]:
            return found[0]
        own = [x for x in starts if len(w) > len(x) and w.startswith(x)]
        if any(starts[x] == "p" for x in own):
            return tox.INSULT
        if own:
            x = min(own, key=[u[2:] for u in units if u[0] == "d"].index)
            doubtful[x].add(w)
            return x
        return tox.OTHER

    classes = ["." if w == "." else kind(w) for w in pieces]
    classes = [(tox.INSULT if len(doubtful[c]) > 1 else tox.OTHER) if c in doubtful else c for c in classes]
    marks, clause = collections.Counter(), []
    for c in [*classes, "."]:
        if c == ".":
            marks += plain_marks(clause)
            clause = []
        else:
            clause.append(c)
    if not {tox.INSULT, tox.THREAT} & set(classes) and not any(len(x) == 1 for x in doubtful.values()):
        return [0.0] * len(tox.FEATURES)
    some = marks["insult"] + marks["aimed"]
    dense = np.log1p(1000 * some / max(50, len(classes))) if some > 1 or marks["aimed"] else 0
    lone = some == 1 and not marks["aimed"] and not marks["threat"]
    return [lone, some > 1, np.log(max(1, some)), marks["aimed"] > 0, marks["threat"] > 0, np.log1p(marks["negated"]), np.log1p(marks["told"]), dense, any(len(x) == 1 for x in doubtful.values())]


def test_features_of_random_clauses():
    rng = random.Random(8)
    units = ["w:zork", "p:grum", "d:blat", "d:blatt", "d:quim"]
    special = [*tox.INSULTS, *tox.THREATS, *tox.TARGETS * 2, *tox.NEGATIONS * 3, *tox.REPORTS * 2, "zork", "zorks", "grum", "Grumble", "blata", "blato", "blatter", "quimby", "quim"]
    texts = [None, "", " ", "...", "zork", "you zork"]
    for _ in range(3000):
        share = rng.random()
        texts.append("".join((rng.choice(special) if rng.random() < share else rng.choice(["the", "été", "o'clock", "7", "Haus"])) + rng.choice([" ", " ", " ", ", ", ". ", "!\n", "; "]) for _ in range(rng.randrange(1, 25))))
    got = Grammar(units).features(pa.array(texts))
    want = np.array([plain_toxic_features(t, units) for t in texts], float)
    assert np.allclose(got, want) and (want != 0).any(0).all()


def test_clauses_decide(spark, docs):
    """A lone insult stays low; one that is aimed, a threat and several do not; negated and reported ones do."""
    x = Grammar(["p:zork"]).features(pa.array(["You zorkish thing. Fine.", "nothing here", None]))
    assert x[0, tox.FEATURES.index("aimed")] == 1 and not x[1:].any()
    high = ["you are garbage", "i will kill you", "trash and scum, worthless scum"]
    low = ["the garbage was collected on tuesday morning by the council", "you are not an idiot", "the teacher said you idiot", "they destroyed a wall", None, ""]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(high + low)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity(rows, labels).collect()}
    assert all(got[k].predicted == 1 for k in range(len(high))) and all(got[len(high) + k].predicted == 0 for k in range(len(low)))
    all_of = toxicity(docs, labels)
    assert all_of.count() == docs.count() and all_of.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").isEmpty()


def test_units_beyond_the_bound(spark, monkeypatch):
    """Words of a large group of toxic copies do not push out an insult that fewer texts have."""
    r = random.Random(8)
    copy = " ".join("".join(r.choice("bcdfghjk") for _ in range(8)) for _ in range(30))
    rows = [(copy, 1, k) for k in range(60)] + [(f"zork {r.randrange(10**6)}", 1, 100 + k) for k in range(20)] + [("plain words here", 0, 200 + k) for k in range(60)]
    sample = spark.createDataFrame(rows, "text string, toxic int, row_id long")
    whole = tox.learned_units(sample)
    assert "w:zork" in whole
    monkeypatch.setattr(tox, "MAX_UNITS", 5)
    assert tox.learned_units(sample) == whole


def test_toxic_held_out(spark):
    labels = spark.read.parquet(table_of("sf0.1", "labels"))
    got = toxicity(spark.read.parquet(table_of("sf0.1", "documents")), labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = got[(got.predicted == 1) & (got.toxic == 1)]
    assert len(hit) > 0.85 * got.toxic.sum() and len(hit) > 0.9 * got.predicted.sum()


def plain_kept(rows):
    """Of (doc_id, text) rows one of each group of near copies, the one of the least doc_id; rows without words all stay."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    top = joined_by([(a, b) for a in range(len(rows)) for b in range(a + 1) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[top(k) if sets[k] else -k - 1].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def plain_unique(rows):
    """rows without the windows of 35 words that start more than once."""
    found = collections.Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))
    out = []
    for k, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - 34) if found[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((k, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    return out


def plain_clean(rows, items):
    """rows without the words in windows of 10 item words; those that are mostly such go."""
    places = lambda t: list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    windows, out = set(), []
    for w in ([m[0] for m in places(t)] for t in items):
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    for k, t in rows:
        at = places(t)
        w = [m[0] for m in at]
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if 2 * len(hit) <= len(w):
            for j in sorted(hit, reverse=True):
                t = t[: at[j].start()] + (t[at[j + 1].start() :] if j + 1 < len(w) else "")
            out.append((k, t))
    return out


def check_pipeline(spark, sf_dir):
    """run() against plain versions of its stages, each on what the one before kept.

    Gives how many documents stages 9 and 4 keep, and how many stages 1 and 3 change or remove.
    """
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own = docs.collect()
    rows = [(r.doc_id, r.text) for r, (_, kept) in zip(own, plain_verdicts(own, quality.LEAST_GROUP)[0], strict=True) if kept]
    one = plain_kept(rows)
    cut = plain_unique(one)
    clean = plain_clean(cut, items)
    want = collections.Counter()
    for k, t in clean:
        ids = word_ids(t)
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[k, at // 2048, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    pieces = got[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert collections.Counter(tuple(None if x != x else int(x) for x in r) for r in pieces.itertuples(index=False)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    return len(rows), len(one), sum(x != y for x, y in zip(one, cut, strict=True)), len(cut) - sum(x in clean for x in cut)


def test_pipeline(spark):
    import corpus_pipeline

    base = os.path.dirname(table_of("sf0.001", "documents"))
    n, kept, _, cleaned = check_pipeline(spark, base)
    assert n > kept and cleaned
    docs = spark.read.parquet(f"{base}/documents.parquet")
    own = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, base)
        assert own.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in own.where("text IS NOT NULL").collect())


def test_pipeline_of_odd_rows(spark, docs, empty, tmp_path):
    """Nulls, ties, repeated rows and clashing names; then a table without rows."""
    import corpus_pipeline

    rows = made()
    items = [("i1", " ".join(words(rows[0][1])[2:20])), ("i2", None), ("i3", "w1 w2"), (None, rows[13][1].upper())]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for name, table in (("odd", clashing(docs)), ("none", empty)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    n, kept, unique, cleaned = check_pipeline(spark, f"{tmp_path}/odd")
    assert n > kept and unique and cleaned
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
