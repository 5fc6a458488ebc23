"""Golden values and edge cases of functions and metrics."""

import pytest
from newsloom.functions import dates, html, urls
from newsloom.functions import text as fx
from newsloom.operators import chunking, metrics
from pyspark.sql import functions as F


def one(spark, column, **values):
    types = values.pop("types", {})
    row = spark.range(1).select(*[F.lit(v).cast(types[k]).alias(k) if k in types else F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def arrays(*values):
    return F.array(*[F.lit(v) for v in values])


@pytest.mark.parametrize(
    "metric,k,relevant,retrieved,want",
    [
        (metrics.hit_rate_at, 2, "a", "ba", 1.0),
        (metrics.hit_rate_at, 2, "a", "bc", 0.0),
        (metrics.mrr_at, 5, "a", "ba", 0.5),
        (metrics.recall_at, 5, "ab", "ax", 0.5),
        (metrics.recall_at, 2, "ab", "aa", 0.5),
        (metrics.ndcg_at, 5, "a", "a", 1.0),
        (metrics.mrr_at, 1, "a", "ba", 0.0),
    ],
)
def test_rank_metrics(spark, metric, k, relevant, retrieved, want):
    assert one(spark, metric(arrays(*relevant), arrays(*retrieved), k)) == want


def test_answers(spark):
    assert one(spark, fx.exact_match(F.lit("Blue Heron!"), F.lit("blue  heron"))) == 1.0
    assert one(spark, fx.exact_match(F.lit(""), F.lit(None).cast("string"))) == 1.0
    assert one(spark, fx.token_f1(F.lit("red red kite"), F.lit("red kite nest flew"))) == pytest.approx(4 / 7)
    assert one(spark, fx.token_f1(F.lit(""), F.lit(""))) == 0.0
    samples = spark.createDataFrame([("Seven ferries, at noon [3]", ["two", "seven ferries at noon"])], "prediction string, accepted_answers array<string>")
    assert metrics.evaluate_answers(samples).first()[1:] == (1.0, 1.0)


def test_citations(spark):
    assert one(spark, fx.citations(F.lit("the dam held [4][1]; see [4] and [12]."))) == [4, 1, 12]
    rows = spark.createDataFrame([(["k3", "k8", "k9"], [5, 6], ["k3", "k4"])], "citation_chunk_ids array<string>, invalid_citation_indices array<int>, relevant_chunk_ids array<string>")
    r = metrics.evaluate_citations(rows).first()
    assert (r.citation_validity, round(r.citation_precision, 4), r.citation_recall) == (0.6, 0.3333, 0.5)
    assert metrics.evaluate_citations(rows.limit(0)).first()[0] == 0.0


def test_corpus_metrics(spark):
    texts = spark.createDataFrame([("tide",), ("reef",), ("tide",), ("tide",)], "text string")
    assert metrics.duplicate_rate(texts).first()[0] == pytest.approx(1 / 2)
    assert [one(spark, fx.ends_sentence(F.lit(t))) for t in ("Rain fell!", "rain fell and", '"Rain?"')] == [True, False, True]


def test_nearest_rank_and_linear_percentiles(spark):
    df = spark.createDataFrame([("m", float(v)) for v in range(1, 11)], "metric string, v double")
    r = metrics.distribution_summary(df, "metric", "v", (0.5, 0.95)).first()
    assert (r["count"], r.p50, r.p95, r["mean"]) == (10, 5.0, 10.0, 5.5)
    r = metrics.latency_summary(df, "v").first()
    assert (r.p50, round(r.p95, 6)) == (5.5, 9.55)


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://Harbour.Org/tides/High/?gclid=7&day=2&utm_medium=m&b=#top", "http://harbour.org/tides/High?day=2&b="),
        ("http://user@h.org:8080/", "http://h.org:8080"),
        ("", ""),
        ("not a url", "not a url"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical(F.lit(url))) == want


def test_url_filters(spark):
    assert [one(spark, urls.allowed(F.lit(u), ["example.com"])) for u in ("https://news.example.com/a", "https://badexample.com/a", "https://EXAMPLE.com")] == [True, False, True]
    assert [one(spark, urls.probable_article(F.lit(u))) for u in ("https://e.com/news/a-long-story-name", "https://e.com/a-long-story-name", "https://e.com/opinion/a-long-story-name")] == [True, False, False]
    links = {"/a": "https://e.com/a", "b": "https://e.com/x/b", "//f.org/c": "https://f.org/c", "https://g.org": "https://g.org", "#top": None, "mailto:x@y": None}
    for link, want in links.items():
        assert one(spark, urls.resolved(F.lit("https://e.com/x/y"), F.lit(link))) == want


def test_names_and_dates(spark):
    assert one(spark, fx.slug(F.lit("Çay & Köprü: 2nd day?"))) == "cay-kopru-2nd-day"
    assert one(spark, fx.slug(F.lit("…"))) == "article"
    assert one(spark, fx.normalized_question(F.lit(" Where did the  Ferry dock ?! "))) == "where did the ferry dock"
    for value, want in {"Tue, 05 Mar 2024 10:00:00 +0100": "2024-03-05T09:00:00Z", "2024-03-05": "2024-03-05T00:00:00Z", "March 5, 2024": "2024-03-05T00:00:00Z", "Thursday, 7 Mar 2024": "2024-03-07T00:00:00Z", "soon": "", None: ""}.items():
        assert one(spark, dates.iso_z(dates.lenient(F.lit(value).cast("string")))) == want
    assert one(spark, dates.label(F.lit(None).cast("timestamp"))) == "undated"


def test_spans_and_quotes(spark):
    assert one(spark, fx.positions_of(F.lit("banana"), F.lit("ana"))) == [1, 3]
    assert one(spark, fx.positions_of(F.lit("aaa"), F.lit("aa"))) == [0, 1]
    assert one(spark, fx.positions_of(F.lit("a.b \\E a.b"), F.lit("\\E"))) == [4]
    assert one(spark, fx.positions_of(F.lit("abc"), F.lit(""))) == []
    span = lambda a, b, t: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text"))
    assert one(spark, fx.quote_supported(F.lit("banana"), F.lit("ana"), F.array(span(0, 3, "ban")))) is True
    assert one(spark, fx.quote_supported(F.lit("banana"), F.lit("ana"), F.array(span(2, 4, "na")))) is False
    assert one(spark, fx.spans_valid(F.lit("abcdef"), F.array(span(1, 3, "bc")))) is True
    assert one(spark, fx.spans_valid(F.lit("abcdef"), F.array(span(1, 9, "bc")))) is False
    assert one(spark, fx.redacted_window(F.lit("0123456789"), F.array(span(2, 4, ""), span(6, 7, "")), 3)) == "01[EVIDENCE]45[EVIDENCE]789"
    labels = F.array(F.struct(F.array(F.lit(1)).alias("start"), F.array(F.lit(2)).alias("end")))
    assert [tuple(s) for s in one(spark, fx.evidence_spans(F.lit("abcdef"), labels, arrays("zz")))] == [(1, 3, "bc")]
    out = F.array(F.struct(F.array(F.lit(90)).alias("start"), F.array(F.lit(95)).alias("end")))
    assert [tuple(s) for s in one(spark, fx.evidence_spans(F.lit("abcdef"), out, arrays("zz", "de")))] == [(3, 5, "de")]
    assert one(spark, fx.answer_leaks(F.lit("The Cat"), F.lit("is the cat?, here"))) is True
    assert one(spark, fx.answer_leaks(F.lit("at"), F.lit("that"))) is False


def test_aligned_chunks(spark):
    got = one(spark, chunking.aligned(F.lit("ab ab cd"), arrays("ab", "ab", "cd", "ab", "zz")))
    assert [tuple(s) if s else None for s in got] == [(0, 2), (3, 5), (6, 8), (0, 2), None]


@pytest.mark.parametrize("text", ["", "one", "a b c d e f g h i j", "para one is here.\n\npara two is there\nwith a line\n\n" * 9, "x" * 300, "a,b,c,d,e,f," * 20, "日本語 " * 40])
def test_recursive_chunks_keep_offsets(text):
    spans = chunking.chunk_spans(text, 12, 3)
    assert all(0 < chunking.count_tokens(text[a:b]) <= 12 for a, b in spans)
    assert [a for a, _ in spans] == sorted(a for a, _ in spans)
    covered = set()
    for a, b in spans:
        covered.update(range(a, b))
    assert all(i in covered for m in chunking.TOKEN.finditer(text) for i in range(*m.span()))


def test_entities(spark):
    assert one(spark, html.stripped(F.lit("<b>caf&eacute;</b>&nbsp;&#8212; 3 &lt; 4 &amp;amp; &hellip;"))) == "café — 3 < 4 &amp; …"
    assert one(spark, html.paragraphs(F.lit("<article><p>one two three four five six seven &euro;8</p></article>"), 8, 9)) == ["one two three four five six seven €8"]


def test_answers_of_any_length(spark):
    long = " ".join(f"w{i % 500}" for i in range(20_000))
    rows = spark.createDataFrame([(long, ["no", long + " tail"]), ("", []), (None, ["x"]), ("a a b", ["a b b", "a a"])], "prediction string, accepted_answers array<string>")
    r = metrics.evaluate_answers(rows).first()
    assert r.n == 4 and r.f1 == pytest.approx((40_000 / 40_001 + 0 + 0 + 0.8) / 4) and r.exact_match == 0.0


def test_html_core(spark):
    page = '<html><head><meta property="og:title" content="A &amp; B"><title>T</title></head><body><nav>n</nav><article><p>One two three four five six seven eight nine ten.</p><p>x</p></article></body></html>'
    assert one(spark, html.title(F.lit(page))) == "A & B"
    assert one(spark, html.paragraphs(F.lit(page))) == ["One two three four five six seven eight nine ten."]
    assert one(spark, html.longest_extraction(arrays("a"), arrays("bb", "c"), arrays("ddd"))) == ["bb", "c"]
    assert '<meta name="author" content="a&quot;b">' in one(spark, html.normalized_page(F.lit("t"), F.lit("u"), F.lit(None).cast("string"), F.lit('a"b'), arrays("p < q")))


def test_derived_title_keeps_its_digits(spark):
    assert one(spark, fx.derived_title(F.lit("call 4630"))) == "call 4630"
    assert one(spark, fx.derived_title(F.lit(" \n  1st of 1 \nx"))) == "1st of 1"


def test_chunks_are_handed_on_in_small_frames(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three {i}\n" * (1 + i % 5)) for i in range(20)] + [(20, None)], "i long, t string").repartition(1)
    want = sorted(map(tuple, chunking.recursive_chunks(docs, "i", "t", 5, 1).collect()))
    sizes = []

    class Frames(chunking.pd.DataFrame):
        def __init__(self, rows, columns):
            sizes.append(sum(len(r[5]) for r in rows))
            super().__init__(rows, columns=columns)

    class Caught:
        def mapInPandas(self, run, schema):  # the task's function, run here
            self.run = run

        def select(self, *_):
            return self

    caught = Caught()
    chunking.recursive_chunks(caught, "i", "t", 5, 1)
    batch = chunking.pd.DataFrame({"a": [str(i) for i in range(20)] + ["20"], "t": [f"one two three {i}\n" * (1 + i % 5) for i in range(20)] + [None]})
    monkeypatch.setattr(chunking, "OUT_CHARS", 50)
    monkeypatch.setattr(chunking.pd, "DataFrame", Frames)
    got = [tuple(r) for frame in caught.run(iter([batch])) for r in frame.itertuples(index=False, name=None)]
    assert sorted(got) == want and max(sizes) < 200 and len(sizes) > 5
