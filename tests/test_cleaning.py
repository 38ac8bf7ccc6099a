"""Hand-made rows pinning the cleaning order contract and null rules."""

from conftest import rows

from quarry.operators import clean as cl

SCHEMA = "ord long, match string, author string, body string, score long"


def df(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_dedup_before_author_filter_loses_both(spark):
    body = "exactly the same words in both copies"
    d = df(spark, [(0, "m", "[deleted]", body, 1), (1, "m", "alive", body, 2)])
    assert cl.clean(d).count() == 0


def test_null_author_kept_null_body_dropped(spark):
    d = df(spark, [(0, "m", None, "a body that is long enough", 1), (1, "m", "x", None, 2)])
    out = rows(cl.clean(cl.harvest_filter(d)), "ord")
    assert out == [(0,)]


def test_length_is_strict(spark):
    d = df(spark, [(0, "m", "a", "x" * 15, 1), (1, "m", "a", "y" * 16, 1)])
    assert rows(cl.min_length_filter(d), "ord") == [(1,)]


def test_two_links_kept_three_dropped(spark):
    two = "see http://a.example and https://b.example"
    three = two + " and http://c.example"
    d = df(spark, [(0, "m", "a", two, 1), (1, "m", "a", three, 1)])
    assert rows(cl.clean(d), "ord") == [(0,)]


def test_entity_replacement_has_no_second_dedup(spark):
    d = df(spark, [(0, "m", "a", "quote &gt; reply text here", 1), (1, "m", "a", "quote > reply text here", 1)])
    out = sorted(rows(cl.clean(d), "ord", "body"))
    assert out == [(0, "quote > reply text here"), (1, "quote > reply text here")]


def test_placeholders_dropped(spark):
    d = df(spark, [(0, "m", "a", "[removed]", 1), (1, "m", "a", "[deleted]", 1), (2, "m", "a", "fine body", 1)])
    assert rows(cl.clean(d), "ord") == [(2,)]


def test_dedup_keeps_first_and_is_idempotent(spark):
    d = df(spark, [(3, "m", "a", "same", 1), (1, "n", "b", "same", 2), (2, "o", "c", None, 3),
                   (0, "p", "d", None, 4)])
    once = cl.dedup_keep_first(d, "body", "ord")
    assert sorted(rows(once, "ord", "match")) == [(0, "p"), (1, "n")]
    twice = cl.dedup_keep_first(once, "body", "ord")
    assert sorted(rows(twice)) == sorted(rows(once))


def test_bot_phrases_off_by_default_and_null_kept(spark):
    d = df(spark, [(0, "m", "a", "I am a bot, this action was performed automatically", 1),
                   (1, "m", "a", None, 1)])
    assert cl.clean(d, drop_bots=False).count() == 1
    assert rows(cl.phrase_filter(d), "ord") == [(1,)]


def test_funnel_counts(spark):
    d = df(spark, [(0, "m", "[deleted]", "body one is here", 1), (1, "m", "a", "body one is here", 1),
                   (2, "m", "a", "[removed]", 1), (3, "m", None, "http://a http://b http://c", 1),
                   (4, "m", "a", "kept body", 1)])
    r = cl.cleaning_funnel(d).collect()[0].asDict()
    assert r == {"n_input": 5, "n_dedup": 4, "n_author": 3, "n_placeholder": 2, "n_links": 1}
