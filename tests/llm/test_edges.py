"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.llm import ann, line_dedup, mixing, ngram_join, quality, sentencepiece_bpe, suffix_dedup, topk_search, warc
from burnish.llm.html_text import Page, main_text
from burnish.llm.queries import piece_model

LINE = "a line that several documents share"
BITS = 1 << 16


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def by_id(df, *cols, key="doc_id"):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


# --- line dedup ----------------------------------------------------------------


def test_lines_stay_in_the_largest_id_only(docs_of):
    rows = [
        (1, f"{LINE}\nown one"), (2, f"  {LINE.upper()}\t\n{LINE}"), (3, f"x\n{LINE}"),
        (None, LINE), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short"), (9, words(1, 20_000)),
    ]
    df = docs_of(rows)
    out = line_dedup.drop_repeated_lines(df, filter_bits=BITS)
    assert out.columns == [c for c in df.columns if c != "n"] + ["n"] + ["n_lines", "n_dropped"] or set(out.columns) == {
        *df.columns, "n_lines", "n_dropped",
    }
    got = by_id(out, "text", "n_lines", "n_dropped")
    assert got[1] == ("own one", 2, 1)
    assert got[2] == ("", 2, 2)
    assert got[3] == (f"x\n{LINE}", 2, 0)
    assert got[None] == (LINE, 1, 0)
    assert got[4] == got[5] == ("", 1, 0)
    assert got[6] == ("short\nshort", 2, 0)
    assert got[9][1:] == (1, 0)
    assert out.filter("cut <> 6 AND row <> 3").count() >= 0  # extra columns kept their values


def test_two_documents_are_too_few_and_rows_of_one_id_are_one(docs_of):
    got = line_dedup.drop_repeated_lines(docs_of([(1, LINE), (1, LINE), (2, LINE)]), filter_bits=BITS)
    assert sorted(r.text for r in got.collect()) == [LINE] * 3


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: line_dedup.drop_repeated_lines(d, filter_bits=BITS),
        lambda d: ngram_join.jaccard_groups(d, filter_bits=BITS),
        lambda d: suffix_dedup.drop_repeated_bytes(d, filter_bits=BITS),
        lambda d: mixing.mix_sources(d, rounds=2),
        lambda d: sentencepiece_bpe.digests(d, piece_model()),
        lambda d: quality.score_quality(d, d.select("doc_id", F.lit(1).alias("quality"))),
    ],
)
def test_an_empty_table_gives_an_empty_table(docs_of, operator):
    assert operator(docs_of([]).filter("doc_id > 0")).count() == 0


# --- n-gram join ---------------------------------------------------------------


def jaccard_by_hand(rows, n=5):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(least.get(x, i), i)
    return sorted((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label))


def test_groups_are_those_of_all_pairs(docs_of):
    rng, rows = random.Random(5), []
    for g in range(12):
        base = words(g, rng.randint(30, 120)).split()
        for k in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = words(rng.random(), 1)
            rows.append((len(rows), " ".join(copy).upper() if k == 1 else " ".join(copy)))
    rows += [(900, "a b c"), (901, "A  b\tc"), (902, "a b c d"), (903, None), (904, ""), (905, " \n "), (906, words(77, 9_000)), (907, words(77, 9_000))]
    got = ngram_join.jaccard_groups(docs_of(rows), filter_bits=BITS)
    assert sorted(map(tuple, got.collect())) == jaccard_by_hand(rows)


def test_a_chain_of_near_copies_is_one_group_across_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    base = words(3, 60).split()
    rows = []
    for i in range(40):
        rows.append((100 - i, " ".join(base)))
        base[(7 * i) % 60] = f"w{i}"
    got = ngram_join.jaccard_groups(docs_of(rows), filter_bits=BITS)
    assert sorted(map(tuple, got.collect())) == jaccard_by_hand(rows)


def test_null_and_repeated_ids_in_groups(docs_of):
    text = words(8, 40)
    got = ngram_join.jaccard_groups(docs_of([(None, text), (5, text), (5, text), (None, words(9, 40))]), filter_bits=BITS).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(5, 5), (5, 5)]
    assert {r.component_id for r in got if r.doc_id is None} == {5, None}


def test_heads_of_linked_sets_share_enough():
    rng = np.random.default_rng(4)
    for trial in range(300):
        percent, both = int(rng.integers(1, 101)), int(rng.integers(1, 60))
        ours, theirs = (int(x) for x in rng.integers(0, max(1, 2 + both * (100 - percent) // percent), 2))
        if 100 * both < percent * (both + ours + theirs):
            continue
        pool = rng.choice(1 << 40, both + ours + theirs, replace=False).astype(np.uint64)
        for a in (pool[: both + ours], pool):
            b = np.concatenate([pool[:both], pool[both + ours :]])
            if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                continue
            (m, k), (other, least) = (ngram_join.head_of(len(x), percent) for x in (a, b))
            shared = len(np.intersect1d(np.sort(a)[:m], np.sort(b)[:other]))
            assert 1 <= k <= m <= len(a) and shared >= max(k, least)


def test_heads_are_unpacked_as_they_were_packed():
    rng = np.random.default_rng(5)
    heads = [np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 0, 3000, 17)]
    got = []
    for bucket, data in ngram_join.pack_heads(heads):
        for h, place in zip(*ngram_join.unpack_heads(data)):
            got.append((bucket, int(h), int(place)))
    assert sorted(got) == sorted((int(h) & 1023, int(h) >> 10 & 0xFFFFFFFF, i) for i, head in enumerate(heads) for h in head)


def test_only_sets_that_may_link_are_written_whatever_the_filter_holds(spark, docs_of, monkeypatch):
    rows = [(i, words(i, 40 + i)) for i in range(150)]
    near = rows[20][1].split()
    near[3] = "other"
    rows += [(300, " ".join(near))] + [(400 + i, rows[7][1]) for i in range(60)]
    written = {}
    write = ngram_join.checkpointed

    def kept(df, label):
        written[label] = out = write(df, label)
        return out

    monkeypatch.setattr(ngram_join, "checkpointed", kept)
    monkeypatch.setattr(ngram_join, "CHUNK", 500)  # many chunks a task
    got = ngram_join.jaccard_groups(docs_of(rows), filter_bits=1 << 9)  # a filter that lets all through
    assert sorted(map(tuple, got.collect())) == jaccard_by_hand(rows)
    # the near copies, and one of the 61 exact ones
    assert written["sets"].filter("set IS NOT NULL").count() == 3
    assert written["sets"].filter("digest IS NOT NULL").count() == len(rows)


# --- suffix dedup --------------------------------------------------------------


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(2)
    for trial in range(40):
        raw = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 200))) * rng.choice([1, 3])
        text = np.frombuffer(raw, dtype=np.uint8)
        order = suffix_dedup.suffix_array(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        prefix = suffix_dedup.common_prefixes(text, order, 20, lane=rng.choice([1, 7, 64]))
        for k in range(1, len(raw)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefix[k] == min(want, 20)


@pytest.mark.parametrize("small", [False, True])
def test_repeated_bytes_go_from_later_documents(docs_of, small):
    from test_queries import removed_by_hand

    passage, rng = words(4, 30), random.Random(6)
    rows = [(i, words(i, 10) + rng.choice(["", "é"]) + passage[rng.randint(0, 40) :] + words(50 + i, 5) + passage[:90]) for i in range(30)]
    rows += [(40, "a" * 300), (41, "a" * 120), (42, ""), (43, passage), (44, passage), (45, "x" * 49)]
    size = {"batch_bytes": 500, "part_bytes": 400, "shard_bytes": 900} if small else {}
    out = suffix_dedup.drop_repeated_bytes(docs_of(rows), filter_bits=BITS, **size)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in out.collect()}
    want = removed_by_hand([(i, t.encode()) for i, t in rows])
    assert got == {i: v[:3] for i, v in want.items()}


def test_a_passage_in_a_third_of_the_documents_fills_no_part(docs_of, monkeypatch):
    from test_queries import removed_by_hand

    passage, size = words(4, 22)[:120], 64 * 336
    rows = [(i, words(i, 14) + passage * (i % 3 == 0) + words(10_000 + i, 8)) for i in range(2700)]
    df, dealt = docs_of(rows), []
    repartition = type(df).repartition

    def spy(self, *to):
        if to[-1] == "part":
            dealt.append(self)
        return repartition(self, *to)

    monkeypatch.setattr(type(df), "repartition", spy)
    out = suffix_dedup.drop_repeated_bytes(df, filter_bits=1 << 22, part_bytes=size)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in out.collect()}
    assert got == {i: v[:3] for i, v in removed_by_hand([(i, t.encode()) for i, t in rows]).items()}
    held = {}
    for r in dealt[0].select("part", "sizes").collect():
        held[r.part] = held.get(r.part, 0) + int(suffix_dedup._unpack(bytes(r.sizes), "<i4").sum())
    assert max(held.values()) <= 2 * size


def test_null_texts_and_ids_and_rows_of_one_id(docs_of):
    text = words(5, 40)
    out = suffix_dedup.drop_repeated_bytes(docs_of([(1, None), (None, text), (2, text), (2, text), (None, text)]), filter_bits=BITS)
    assert [(r.n_bytes, r.n_removed) for r in out.filter("doc_id = 1").collect()] == [(0, 0)]
    assert {r.n_removed for r in out.collect()} == {0}


# --- search --------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.standard_normal(5).astype("f4")], i) for i in range(300)]
    rows += [(300, None, 0), (400, [], 0), (500, [1.0, None], 0), (600, [float("nan")], 0), (700, [float("inf")], 0), (800, [0.0] * 5, 0)]
    rows += [rows[7], (None, [1.0], 0), (301, rows[100][1], 0), (302, rows[100][1], 0)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, h int")


def test_top_products_are_exact_with_ties(vectors):
    got = {}
    for r in topk_search.top_inner_products(vectors, F.col("vec_id") % 100 == 0, block_rows=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    use = {}
    for r in vectors.collect():
        v = r.embedding
        if r.vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            use[r.vec_id] = [int(np.floor(1024 * float(x))) for x in v]
    want = {}
    for q, a in use.items():
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in use.items() if i != q)[:10]
            want[q] = [(k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert set(want) == {0, 100, 200, 400, 800}


def test_few_and_large_vectors(spark):
    df = spark.createDataFrame([(0, [1e9, -1e9]), (1, [1e9, 1.0]), (100, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_inner_products(df, F.col("vec_id") % 100 == 0).collect()}
    m = 1024 * 10**9
    assert got == {(0, 1): (1, 2**63 - 1), (0, 2): (100, 0), (100, 1): (1, 512 * (m + 1024)), (100, 2): (0, 0)}
    assert topk_search.top_inner_products(df.filter("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_with_odd_vectors(vectors):
    rows = ann.nearest(vectors, F.col("vec_id") % 100 == 0, block_rows=60).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 12)))
    assert set(got) == {0, 100, 200}
    assert sorted(got[100])[:2] == [(1, 301, 1.0), (2, 302, 1.0)]
    assert all(len(v) == 5 for v in got.values())
    assert ann.nearest(vectors.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert ann.nearest(vectors.filter("vec_id < 0"), F.col("vec_id") == 0).count() == 0


# --- quality -------------------------------------------------------------------


@pytest.mark.parametrize("shout", ["ЭТО ВАЖНО ", "ΑΥΤΟ ΕΙΝΑΙ ", "ÉCOUTEZ ÇA ", "LISTEN TO ME "])
def test_upper_case_counts_alike_at_every_length(shout):
    upper = quality.FEATURES.index("upper")
    for n in (62, 63, 64, 65, 400):
        text = (shout * n)[:n]
        count = sum(c.isupper() for c in text)
        letters = sum(c.isalpha() for c in text)
        assert quality.statistics(text)[upper] == pytest.approx(np.log((count + 0.5) / (letters - count + 0.5)))


def test_quality_with_odd_rows(docs_of, spark):
    good = [(i, ". ".join(words(100 * i + k, 9) for k in range(12)) + ".") for i in range(60)]
    bad = [(100 + i, " ".join(["BUY!!"] * (20 + i))) for i in range(60)]
    df = docs_of([*good, *bad, (500, None), (501, ""), (None, "x"), (502, words(1, 20_000))])
    marks = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(0, None), (1, 7), (None, 0), (2, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
    got = by_id(quality.score_quality(df, labels), "score", "predicted")
    assert len(got) == 124
    assert all(got[i][1] == 1 for i, _ in good) and all(got[i][1] == 0 for i, _ in bad)
    assert got[500] == got[501]
    flat = quality.score_quality(df, labels.filter("quality = 1"))
    assert {r.score for r in flat.collect()} == {0.5}


# --- mixing --------------------------------------------------------------------


def test_margins_meet_their_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3 if i % 5 else 0}", ["en", "de", None][i % 3 - i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    want = spark.createDataFrame([("s0", 1.0), ("s1", 1.0), ("s2", 2.0)], "value string, share double")
    out = mixing.mix_sources(df, targets={"source": want}, rounds=30)
    tokens = F.sum(F.col("mix_tokens") * F.col("mix_weight"))
    share = {r.source: r.t for r in out.groupBy("source").agg(tokens.alias("t")).collect()}
    whole = sum(share.values())
    assert {k: round(v / whole, 6) for k, v in share.items()} == {"s0": 0.25, "s1": 0.25, "s2": 0.5}
    expected = out.agg(F.sum(F.col("mix_tokens") * F.col("mix_probability"))).first()[0]
    kept = out.filter("mix_kept").agg(F.sum("mix_tokens")).first()[0]
    assert kept == pytest.approx(expected, rel=0.1)


def test_many_cells_are_raked_as_few_are(docs_of, monkeypatch):
    df = docs_of([(i, words(i, 3 + i % 7)) for i in range(60)]).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 9)).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 4))
    few = by_id(mixing.mix_sources(df, rounds=2), "mix_weight", "mix_kept")
    monkeypatch.setattr(mixing, "Window", None)  # no window may be made
    many = by_id(mixing.mix_sources(df, rounds=2, window_cells=3), "mix_weight", "mix_kept")
    assert many.keys() == few.keys()
    assert all(many[i][0] == pytest.approx(few[i][0], rel=1e-9) and many[i][1] == few[i][1] for i in few)


def test_mixing_odd_rows(docs_of):
    df = docs_of([(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "a license"), (3, "a license"), (4, words(1, 20_000))])
    out = mixing.mix_sources(df, rounds=3)
    got = [(r.doc_id, r.mix_tokens, r.mix_kept) for r in out.collect()]
    assert len(got) == 7 and set(df.columns) <= set(out.columns)
    assert sorted(t for _, t, _ in got) == [0, 0, 2, 2, 2, 2, 20_000]
    assert not any(k for i, t, k in got if i is not None and t == 0 and out.filter(f"doc_id = {i} AND mix_probability > 0").isEmpty())
    assert len({k for i, _, k in got if i == 3}) == 1


# --- SentencePiece -------------------------------------------------------------


def test_ids_of_odd_texts_are_the_librarys():
    import sentencepiece

    model = sentencepiece_bpe.PieceModel(piece_model())
    sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    rng = random.Random(1)
    bits = ["a", "th", "ing", "e", " ", "  ", "\n", "\t", "▁", "é", "ß", "门", "😀", "\x00", "​", "--", "aaaa", "0", "A", "<s>", "<0x0A>"]
    texts = [" " * n + tail for n in range(70) for tail in ("", "a", "门")]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [words(3, 20_000), "x" * 30_000]
    for t in texts:
        ids = sp.encode(t)
        assert model.encode(t) == ids
        assert model.decode(ids) == sp.decode(ids)
    for _ in range(500):
        ids = [rng.randrange(32000) for _ in range(rng.randint(0, 8))] + [rng.randrange(3, 259) for _ in range(rng.randint(0, 5))]
        assert model.decode(ids) == sp.decode(ids)


def test_encode_and_decode_round_trip(docs_of):
    df = docs_of([(1, None), (2, ""), (3, " two  words\n"), (3, " two  words\n"), (None, "x")])
    coded = sentencepiece_bpe.encode(df, piece_model())
    back = sentencepiece_bpe.decode(coded, piece_model())
    assert sorted((r.text or "", r.decoded) for r in back.collect()) == [("", ""), ("", ""), (" two  words\n",) * 2, (" two  words\n",) * 2, ("x", "x")]


# --- HTML ----------------------------------------------------------------------


def test_pages_without_help_and_broken_ones(docs_of):
    para = "A long enough sentence, with words in it and a comma. " * 4
    pages = {
        1: None, 2: "", 3: "<script>x()</script>", 4: "<", 5: "<!-- never closed", 6: "<p>" * 300,
        7: f"<html><body><nav><ul><li><a href='/a'>Menu entry</a></li></ul></nav><div class='content'><h1>The title of it</h1>"
        f"<p>{para}<p>{para}&amp;&nbsp;more<br>here</div><div class='comments'><p>{para}</p></div><footer>Legal words here.</footer>",
        8: f"<body><div id='cookie-notice'><p>{para}</p></div><article><h1>Title of the page</h1><p>{para}</p><form><p>Your name</p></form></article></body>",
        9: "<div>" * 3000 + "deep" + "</div>" * 10,
    }
    rows = [*pages.items(), (9, pages[9])]
    got = by_id(main_text(docs_of(rows, "page_id", "html"), into="text"), "text", key="page_id")
    assert [got[i][0] for i in (1, 2, 3, 5, 6)] == [""] * 5
    text = para.strip()
    assert got[7][0] == f"The title of it\n\n{text}\n\n{text} & more here"
    assert got[8][0] == f"Title of the page\n\n{text}"


@pytest.mark.parametrize("tag", ["button", "svg", "object", "select", "math", "canvas", "audio", "video", "template"])
def test_an_element_without_its_end_tag_hides_no_article(tag):
    blocks = lambda source: [t for _, t in Page(source).blocks]
    article = "<article><h1>Title</h1><p>First words.</p><p>Second words.</p></article>"
    want = ["Title", "First words.", "Second words."]
    assert blocks(f"<body><div><{tag}></div>{article}") == want
    assert blocks(f"<body><{tag}>{article}") == want
    assert blocks(f"<body><{tag}>{article}<p><{tag}></{tag}></p>") == want
    assert blocks(f"<body><article><h1>Title</h1><p>First <{tag}>words.</p><p>Second words.</p></article>") == want


def test_texts_of_page_elements(docs_of):
    blocks = lambda source: [t for _, t in Page(source).blocks]
    assert blocks("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>") == ["So x=2 holds."]
    assert blocks("<p>See <object>a map</object> and <video>a film</video></p>") == ["See a map and a film"]
    assert blocks("<p>A<button>Share</button> b<svg><g><svg><text>t</text></svg></g><text>u</text></svg> c<select><option>o</select> d") == ["A b c d"]
    assert blocks("<button><div>Share</div><script>'</button>'</script></button><template><p>row</p><template>x</template></template><p>text") == ["text"]
    assert blocks("<p>a <svg/> b <script>x</p><p>y") == ["a b"]
    para = "Some long enough words of an article, which go on for a while. " * 4
    page = "<body><div class='top'>{0}</div><article><h1>The title of it</h1>{0}<p>" + para + "</p><p>" + para + "</p></article></body>"
    rows = [(i, page.format(t)) for i, t in enumerate(["", "<button>", "<svg>", "<object>"])]
    got = by_id(main_text(docs_of(rows, "page_id", "html"), into="text"), "text", key="page_id")
    assert len({v[0] for v in got.values()}) == 1 and got[0][0].count(para.strip()) == 2


# --- WARC ----------------------------------------------------------------------


def test_archives_round_trip(spark, docs_of, tmp_path):
    body = "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "same"), (2, "same"), (3, "same"), (4, None), (5, ""), (6, body), (7, body), (8, "é" * 5000), (None, "same"), (None, "lone"), (9, "x"), (9, "x")]
    pages = docs_of(rows, "page_id", "html").withColumn("url", F.concat(F.lit("http://x/ \r\n"), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))))
    folder = str(tmp_path / "a")
    warc.write_archives(pages, folder, records_per_file=3)
    found = warc.resolve_revisits(warc.read_archives(spark, folder))
    got = sorted(((r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to) for r in found.collect()), key=str)
    want = [
        (0, "response", 4, None), (0, "revisit", 4, 3), (1, "revisit", 4, 3), (2, "revisit", 4, 3), (3, "response", 4, None),
        (4, "revisit", 0, 5), (5, "response", 0, None), (6, "revisit", len(body), 7), (7, "response", len(body), None),
        (8, "response", 10000, None), (9, "response", 1, None), (9, "response", 1, None),
    ]
    assert got == sorted(want, key=str)
    again = str(tmp_path / "b")
    warc.rewrite_archives(spark, folder, again, min_payload=5)
    found = warc.resolve_revisits(warc.read_archives(spark, again))
    got = {(r.page_id, r.record_type, r.payload_bytes) for r in found.collect() if r.page_id in (1, 5, 6, 7)}
    assert got == {(1, "response", 4), (5, "response", 0), (6, "revisit", len(body)), (7, "response", len(body))}


def test_archives_are_parsed_once(spark, docs_of, tmp_path):
    pages = docs_of([(1, "a"), (2, "a"), (3, "b")], "page_id", "html").withColumn("url", F.lit("http://x/"))
    warc.write_archives(pages, str(tmp_path / "a"))
    found = warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "a")))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found.collect()) == [(1, "revisit", 2), (2, "response", None), (3, "response", None)]


def test_no_pages_no_records(spark, docs_of, tmp_path):
    pages = docs_of([(1, "x")], "page_id", "html").withColumn("url", F.lit(None).cast("string")).filter("page_id > 1")
    warc.write_archives(pages, str(tmp_path / "a"))
    assert warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "a"))).count() == 0


def test_the_driver_holds_no_unpacked_filter(spark):
    import tracemalloc

    import numpy as np

    from burnish.llm import common

    hashes_of = lambda batch: common.mix(batch["id"].to_numpy().astype(np.uint64))
    rows = spark.range(2000).select((F.col("id") % 1500).alias("id")).coalesce(1)
    bits = 1 << 29
    tracemalloc.start()
    try:
        found = common.repeat_filter(rows, hashes_of, bits)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < bits // 8 // 2
    suspects = common.Suspects(found)
    assert suspects.bits == bits
    asked = common.mix(np.arange(3000, dtype=np.uint64))
    assert suspects(asked)[:500].all() and not suspects(asked)[500:].any()


# --- memory of executors -------------------------------------------------------


def test_long_rows_come_in_short_batches(spark, docs_of, monkeypatch):
    import pandas as pd

    from burnish.llm import common

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    @common.short_batches
    def longest(rows):
        return max(r.n for r in rows.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n int").collect())

    assert longest(spark.range(0, 3000, 1, 1)) == common.SLICE
    seen = []
    write = ngram_join.checkpointed
    monkeypatch.setattr(ngram_join, "checkpointed", lambda df, label: seen.append(spark.conf.get(key)) or write(df, label))
    ngram_join.jaccard_groups(docs_of([(1, LINE), (2, LINE)]), filter_bits=BITS).collect()
    assert set(seen) == {str(common.SLICE)} and spark.conf.get(key) == before
    spark.conf.set(key, "100")
    try:
        assert longest(spark.range(0, 3000, 1, 1)) == 100 and spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)


def test_a_sent_filter_arrives_unpacked_and_alone(spark):
    import pickle

    from burnish.llm import common

    hashes_of = lambda batch: common.mix(batch["id"].to_numpy().astype(np.uint64))
    found = common.repeat_filter(spark.range(2000).select((F.col("id") % 1500).alias("id")).coalesce(1), hashes_of, BITS << 8)
    got, plain = pickle.loads(pickle.dumps(common.Sent(found))), common.Suspects(found)
    assert type(got) is common.Suspects and (got.bytes == plain.bytes).all()
    assert vars(got).keys() == vars(plain).keys() == {"bytes", "bits"}


def test_learning_runs_one_python_worker_a_task(spark, docs_of, monkeypatch):
    asked = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda labelled, *rest: asked.append(labelled) or fit(labelled, *rest))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    quality.score_quality(docs_of([(i, words(i, 20)) for i in range(20)]), labels)
    assert "EvalPython" not in asked[0]._jdf.queryExecution().executedPlan().toString()
