import inspect
import itertools
import random
import types
from collections import Counter

import pandas as pd
import pytest

from topicloom.operators import academic, corpus, evolution, models, phrases, topics


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, []), (4, ["a", "b", "c", "d"])], "id int, tokens array<string>").cache()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_frequencies(docs):
    assert rows(corpus.document_frequency(docs), "token", "doc_count") == [("a", 3), ("b", 2), ("c", 2), ("d", 1)]
    assert rows(corpus.high_df_tokens(docs, 0.75), "token", "doc_count") == [("a", 3)]
    assert rows(corpus.high_df_tokens(docs, 0.76), "token") == []
    assert corpus.high_df_tokens(docs, 1.0).count() == 0
    assert rows(corpus.df_limits(docs, 2, 1.0), "token", "mark")[-1] == ("d", "low")
    assert rows(corpus.df_limits(docs, 2, 0.9), "token", "mark")[0] == ("a", "high")
    assert rows(corpus.filter_extremes(docs, 2, 0.5, 1), "token") == [("b",)]
    assert rows(corpus.bag_of_words(docs, "id").where("id = 1"), "token", "n") == [("a", 2), ("b", 1)]


def test_filters_keep_order_and_empty_documents(docs):
    assert rows(corpus.drop_high_df(docs, "id", 0.75), "id", "tokens") == [(1, ["b"]), (2, ["c"]), (3, []), (4, ["b", "c", "d"])]
    same = docs.where("id < 3").selectExpr("id", "array('x') as tokens")
    assert rows(corpus.drop_high_df(same, "id", 0.5, guard=True), "id", "tokens") == [(1, ["x"]), (2, ["x"])]
    assert rows(corpus.drop_high_df(same, "id", 0.5), "id", "tokens") == [(1, []), (2, [])]
    assert corpus.drop_high_df(docs.limit(0), "id").count() == 0


def test_phrases(spark):
    docs = spark.createDataFrame([(i, ["new", "york", "city", "new", "york"]) for i in range(10)] + [(99, ["a", "a", "a"])], "id int, tokens array<string>")
    assert rows(phrases.bigram_counts(docs, "id", 5), "a", "b", "n") == [("city", "new", 10), ("new", "york", 20), ("york", "city", 10)]
    merged = dict(rows(phrases.merge(docs, "id", [[("new", "york")], [("new_york", "city")]]), "id", "tokens"))
    assert merged[0] == ["new_york_city", "new_york"]
    assert dict(rows(phrases.merge(docs, "id", [[("a", "a")]]), "id", "tokens"))[99] == ["a_a", "a"]
    score = {(r.a, r.b): r.score for r in phrases.scores(docs, "id", 5, 0.0).collect()}
    assert score["new", "york"] == pytest.approx((20 - 5) * 8 / (20 * 20))


def test_windows_agree_with_brute_force(spark):
    rng = random.Random(1)
    data = [[rng.choice("abcdef") for _ in range(rng.randrange(0, 40))] for _ in range(30)]
    got = {(r.a, r.b): r.n for r in phrases.windows(spark.createDataFrame(list(enumerate(data)), "id int, tokens array<string>"), "id", ["a", "b", "c"], 7).collect()}
    want = Counter()
    for d in data:
        for s in range(max(1, len(d) - 6)) if d else ():
            want[None, None] += 1
            seen = sorted(set(d[s : s + 7]) & {"a", "b", "c"})
            want.update(itertools.combinations_with_replacement(seen, 2))
    assert got == dict(want)


def test_topics(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5, 0.0]), (2, []), (3, None), (4, [0.0, 0.1, 0.9])], "id int, v array<double>")
    assert [(r.id, r.topic_id) for r in topics.assignments(df, "id", "v").orderBy("id").collect()] == [(1, 0), (2, -1), (3, -1), (4, 2)]
    docs = spark.createDataFrame([(1, 0), (2, 0), (3, 2), (4, -1)], "id int, topic_id int")
    assert rows(topics.dense_counts(docs, 4), "topic_id", "n") == [(0, 2), (1, 0), (2, 1), (3, 0)]
    assert rows(topics.shares(docs), "topic_id", "pct") == [(0, 66.67), (2, 33.33)]
    words = spark.createDataFrame([(0, "b", 1.0), (0, "a", 1.0), (0, "c", 2.0)], "topic_id int, word string, weight double")
    assert rows(topics.top_words(words, 2), "rank", "word") == [(1, "c"), (2, "a")]
    assert sum(r.weight for r in topics.normalized(words).collect()) == pytest.approx(1)
    lists = spark.createDataFrame([(3, ["capsule", "que", "los", "las"]), (4, ["robot", "desk"]), (5, [])], "topic_id int, words array<string>")
    assert rows(topics.named(lists), "short_name") == [("T03_MULTI_Spanish_Mixed_Travel_Commentary",), ("T04_EN_Mixed_Travel_Commentary",), ("T05_EN_Mixed_Travel_Commentary",)]
    lists = spark.createDataFrame([(0, ["robot", "job"]), (1, ["robot", "coffee"]), (2, ["Yang", "dan", "KITA", "yen"]), (3, ["x"] * 15 + ["news"])], "topic_id int, words array<string>")
    assert rows(topics.named(lists), "short_name") == [("T00_EN_Robot_vs_Human_Service_Jobs_Future",), ("T01_EN_Kagoshima_RobotFrontDesk_Dialogue_ServiceRants",), ("T02_MULTI_Malay_Indonesian_Tokyo_Japan_Travel_Vlog",), ("T03_EN_Mixed_Travel_Commentary",)]
    assert "[('Malay/Indonesian', 3)]" in topics.named(lists).where("topic_id = 2").first().description


def test_known_shares(spark):
    counts = [19, 217, 115, 139, 31, 14, 19, 56, 287]
    docs = spark.createDataFrame([(t,) for t, n in enumerate(counts) for _ in range(n)], "topic_id int")
    assert [r.pct for r in topics.shares(docs).orderBy("topic_id").collect()] == [round(100 * n / 897, 2) for n in counts]


def test_evolution(spark):
    data = [("2024-01-05", 0)] * 3 + [("2024-02-01", 1)] + [("2024-03-09", 0)] * 2 + [("bad", 0), (None, 1), ("2024-03-10", 1)]
    rows_ = evolution.retained(evolution.counts(spark.createDataFrame(data, "t string, topic int"), "t", "topic"), 3)
    assert [(str(r.period)[:7], r.topic_id, r.n, r.ord) for r in rows_.orderBy("period", "topic_id").collect()] == [("2024-01", 0, 3, 1), ("2024-03", 0, 2, 2), ("2024-03", 1, 1, 2)]
    words = spark.createDataFrame([(0, ["a", "b"]), (1, ["b", "c"])], "topic_id int, words array<string>")
    links = evolution.edges(rows_, words, 1 / 3)
    assert rows(links, "source_topic", "target_topic", "value") == [(0, 0, 2.0), (0, 1, 0.333333)]
    assert [r.label for r in evolution.nodes(rows_, links).orderBy("id").collect()] == ["2024-01 · T1", "2024-03 · T1", "2024-03 · T2"]
    none = spark.createDataFrame([], "topic_id int, words array<string>")
    assert rows(evolution.edges(rows_, none, 0.5), "source_topic", "target_topic", "value") == [(0, 0, 2.0)]


def test_turning_point(spark):
    ks = [3, 4, 5, 6, 7, 8, 9, 10, 12, 15]
    pp = [886.626, 849.631, 847.753, 849.234, 848.221, 847.995, 848.989, 854.190, 845.440, 849.639]
    cv = [0.28712, 0.27498, 0.28437, 0.30543, 0.42733, 0.40100, 0.47739, 0.43222, 0.44706, 0.45009]
    sweep = spark.createDataFrame([*zip(ks, pp, cv, strict=True), (20, None, 0.9), (21, 1.0, float("nan"))], "K int, perplexity double, coherence_cv double")
    got = models.turning_points(sweep).collect()
    assert [r.asDict() for r in got] == [{"cv_knee_K": 9, "perplexity_elbow_K": 4, "cv_best_K": 9, "perplexity_best_K": 12, "jump_from": 6, "jump_to": 7, "recommended_K_composite": 6}]
    assert models.turning_points(sweep.limit(3)).count() == 0 and models.turning_points(sweep.limit(0)).count() == 0


def test_planted_topics_are_found(spark):
    rng = random.Random(0)
    themes = [[f"{t}{i}" for i in range(8)] for t in ("sun", "sea", "ski")]
    data = [(d, [rng.choice(themes[d % 3]) for _ in range(30)]) for d in range(90)]
    docs = spark.createDataFrame(data, "id int, tokens array<string>").cache()
    b = models.fit_lda(docs, "id", 3, 25, "symmetric", batch=True)
    got = {r.id: r.topic_id for r in models.lda_assignments(b, "id").collect()}
    assert all(len({got[d] for d in range(90) if d % 3 == t}) == 1 for t in range(3)) and len(set(got.values())) == 3
    assert all(abs(sum(r.theta) - 1) < 1e-6 for r in b.theta.collect())
    c = models.fit_clusters(docs, "id", 3, components=5)
    lab = {r.id: r.topic_id for r in c.labels.collect()}
    assert all(len({lab[d] for d in range(90) if d % 3 == t}) == 1 for t in range(3))
    top = topics.top_words(b.words, 8)
    assert models.c_v(docs, top, "id") > 0.5
    trained = models.train_and_assign(docs.selectExpr("id", "concat_ws(' ', tokens) AS text"), docs, "id", "text", 3, 15)
    assert trained.dictionary.count() == 3 and trained.assigned.where("lda_topic_00_theta >= 0").count() == 90
    with pytest.raises(models.EmptyCorpus):
        models.fit_lda(docs.limit(0), "id", 3)
    grid, best = models.tune(docs, "id", [2, 3], ["symmetric"], 3, 60, score="perplexity")
    assert grid.count() == 2 and best["k"] in (2, 3)
    words = models.word_map(b.words, 0.01, 20)
    assert words.count() == 20


def test_academic_pipeline(spark):
    df = spark.createDataFrame([(i, f"The beautiful robot hotels were amazing #{i} https://x.y and capsule rooms") for i in range(12)], "id int, text string")
    got = academic.preprocess(df, "id", "text", "en", {"df_no_below": 2, "df_no_above": 1.0, "ngram_min_count": 50})
    assert got.tokens.first().tokens[:2] == ["beautiful", "robot"]
    assert "robot" in corpus.preprocess(df, "id", "text").first().tokens


def test_academic_report_and_frame(spark):
    texts = ["The t echnology of ospitality robots is amazing", "robots in a capsule", None, "", "robots robots"]
    df = spark.createDataFrame([(1, t, "x") for t in texts], "id int, text string, text_preprocessed_academic string")
    frame, report = academic.preprocess_for_lda(df, {"df_no_below": 1, "df_no_above": 1.0, "ngrams": False, "language": "en"}, ["Capsule!"], "en")
    assert frame.columns == ["id", "text", "__text_col_used", "text_preprocessed_academic", "text_preprocessed_academic_tokens", "text_preprocessed_academic_token_count"]
    got = {r.text: (r.text_preprocessed_academic_tokens, r.text_preprocessed_academic_token_count) for r in frame.collect()}
    assert got == {texts[0]: ("technology hospitality robot", 3), texts[1]: ("robot", 1), None: ("", 0), "": ("", 0), texts[4]: ("robot robot", 2)}
    r = report.first()
    assert (r.language, r.input_docs, r.non_empty_docs, r.total_tokens, r.kept_vocab, r.stopwords_removed, r["_meta_text_col"], r["_meta_n_rows"]) == ("en", 5, 3, 6, 3, 1, "text", 5)
    assert r.dropped_too_short == 5 and r.pos_noun == 6 + 1 and r.pos_dropped == 1 and r.avg_tokens == 2.0
    with pytest.raises(ValueError, match="rows"):
        academic.preprocess_for_lda(df.limit(0))
    auto, _ = academic.preprocess_for_lda(df.drop("id"), {"df_no_below": 1, "df_no_above": 1.0})
    assert auto.count() == 5
    zh = academic.preprocess(spark.createDataFrame([(1, "酒店機場很好 房"), (2, "酒店")], "id int, t string"), "id", "t", "zh", {"df_no_below": 1, "df_no_above": 1.0, "ngrams": False})
    assert sorted(t for r in zh.tokens.collect() for t in r.tokens) == ["很好", "机场"]  # the corpus words hold 酒店
    # a named preset's lengths hold for Chinese too
    assert all(not r.tokens for r in academic.preprocess(spark.createDataFrame([(1, "酒店")], "id int, t string"), "id", "t", "zh", "paper").tokens.collect())


def test_filters_beyond_the_held_list(spark, docs, monkeypatch):
    from topicloom.operators import joins

    more = docs.union(docs.limit(1)).union(spark.createDataFrame([(7, None)], "id int, tokens array<string>"))
    def kept(how):
        return sorted(map(str, corpus.keep_tokens(more, "id", spark.createDataFrame([("a",), ("c",), ("c",)], "token string"), how).collect()))

    want = [kept("left_semi"), kept("left_anti")]
    assert len(want[0]) == 6 and "tokens=['a', 'a']" in want[0][0]
    monkeypatch.setattr(corpus, "HELD_TOKENS", 1)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    assert [kept("left_semi"), kept("left_anti")] == want


def test_numbers_in_order_without_one_task(spark):
    rng = random.Random(3)
    keys = [rng.randrange(40) for _ in range(300)] + [7] * 150 + [None] * 3
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, rn0 int")
    got = sorted((r.rn, r.k) for r in models.numbered(df, "k").collect())
    assert [n for n, _ in got] == list(range(1, 454)) and [k for _, k in got] == sorted(keys, key=lambda k: -1 if k is None else k)
    assert models.ordered_split(df, "k").where("train").count() == 362
    assert models.numbered(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("batch", [False, True])
def test_a_pass_reads_every_document(spark, batch):
    # each document has a word of its own; unread, it keeps its start, about 1 for each topic
    docs = spark.createDataFrame([(i, [f"w{i:03d}"] * 50 + ["common"]) for i in range(60)], "id int, tokens array<string>")
    b = models.fit_lda(docs, "id", 2, 1, "symmetric", no_below=1, no_above=1.0, batch=batch)
    mass = dict(zip(b.vocabulary, b.model.topicsMatrix().toArray().sum(1), strict=True))
    assert len(mass) == 61 and [w for w in mass if mass[w] < 2.7] == []
    assert b.theta.count() == 60


def test_phrases_beyond_the_table_are_merged(spark, monkeypatch):
    rng = random.Random(1)
    data = [(i // 2, [rng.choice("abcdef") for _ in range(rng.randrange(12))]) for i in range(120)] + [(99, None)]
    docs = spark.createDataFrame(data, "id int, tokens array<string>")
    made = [lambda: phrases.learn_by_count(docs, "id", 5), lambda: phrases.learn(docs, "id", 2, 0.01)]
    whole = [rows(phrases.merge(docs, "id", f()), "id", "tokens") for f in made]
    monkeypatch.setattr(phrases, "MAX_PHRASES", 3)
    cut = [rows(phrases.merge(docs, "id", f()), "id", "tokens") for f in made]
    assert cut == whole and any("_" in w for _, words in whole[1] for w in words)


def test_queries_fit_with_the_operators_limits(monkeypatch):
    from topicloom.plans import modelled

    class Stop(Exception):
        pass

    def run(query, name):
        signature = inspect.signature(getattr(models, name))

        def record(*args, **named):
            got = signature.bind(*args, **named)
            got.apply_defaults()
            raise Stop(got.arguments, {n: p.default for n, p in signature.parameters.items()})

        with monkeypatch.context() as m, pytest.raises(Stop) as stopped:
            m.setattr(modelled, "_docs", lambda *_: None)
            m.setattr(modelled, "table", lambda *_: types.SimpleNamespace(select=lambda *_: None))
            m.setattr(models, name, record)
            query(None, "")
        return stopped.value.args

    limits = ("ks", "iterations", "passes", "sample", "keep_n", "max_features", "components")
    for query, name in ((modelled.k_sweep, "k_sweep"), (modelled.tuning_grid, "tune"), (modelled.lite_cluster, "fit_clusters"), (modelled.lite_cluster_terms, "fit_clusters"), (modelled.coherence, "fit_lda"), (modelled.train_and_assign, "train_and_assign")):
        got, default = run(query, name)
        assert [(name, n, got[n]) for n in limits if n in got and default[n] is not inspect.Parameter.empty and got[n] != default[n]] == []


def test_streams_write_the_last_windows(spark, tmp_path):
    from topicloom.plans import modelled

    hours = pd.date_range("2024-01-01", periods=100, freq="h", tz="UTC").astype("datetime64[us, UTC]")
    pd.DataFrame({"ts": hours, "event_type": ["a", "b"] * 50, "user_id": range(100)}).to_parquet(f"{tmp_path}/events.parquet")
    assert [sum(r.n for r in q(spark, str(tmp_path)).collect()) for q in (modelled.stream_topic_counts, modelled.stream_sessions)] == [100, 100]
