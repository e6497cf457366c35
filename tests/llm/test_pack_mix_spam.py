import random

import numpy as np
import pytest

from notewarp.llm import mixing, packing, queries, spam, tokens

DOC = "doc_id long, text string, lang string, source string, piece int, cell string"
needs_ranks = pytest.mark.skipif(not __import__("os").path.exists(tokens.RANKS), reason="no vocabulary")


@pytest.mark.parametrize("seed", range(5))
def test_packing_keeps_all_limits(seed):
    rng = np.random.default_rng(seed)
    sizes = np.column_stack([rng.integers(1, 400, 300), np.ones(300), rng.integers(0, 200, 300)]).astype(float)
    limits = np.array([512.0, 6.0, 300.0])
    bins = packing.pack(sizes, limits)
    assert (bins >= 0).all()
    for b in range(bins.max() + 1):
        assert (sizes[bins == b].sum(axis=0) <= limits).all() and (bins == b).any()
    assert bins.max() + 1 <= 1.1 * max(np.ceil(sizes.sum(axis=0) / limits))
    assert len(packing.pack(np.zeros((0, 3)), limits)) == 0


@needs_ranks
def test_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 20)
    rng = random.Random(1)
    rows = [(i, "Prompt here\n" + "word " * rng.randrange(1, 60), "en", "s", 1, "x") for i in range(60)] + [(900, "word " * 500, None, None, 1, "x"), (901, None, None, None, 1, "x"), (902, "", None, None, 1, "x"), (None, "a", None, None, 1, "x"), (903, "x" * 5000, None, None, 1, "x")]
    docs = spark.createDataFrame(rows, DOC)
    limits = spark.createDataFrame([("container", 100, 0, "tokens"), ("container_small", 64, 0, "tokens"), ("summary", 9, 0, "characters")], "item_kind string, max_size long, overlap_size long, size_unit string")
    got = packing.containers(docs, limits, max_segments=5).toPandas()
    enc = tokens.encoding()
    true = {d: len(enc.encode_ordinary(t)) for d, t, *_ in rows if d is not None and t}
    for kind, size in (("container", 100), ("container_small", 64)):
        mine = got[got.item_kind == kind]
        assert mine.groupby("doc_id").n_tokens.sum().to_dict() == true
        per = mine.groupby("container_id")
        assert per.n_tokens.sum().max() <= size and per.doc_id.count().max() <= 5
        assert set(mine[mine.piece > 0].doc_id) == {d for d, n in true.items() if n > size}
        for d, rows_ in mine.groupby("doc_id"):
            ends = sorted(zip(rows_.token_start, rows_.n_tokens))
            assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    tight = packing.containers(docs, limits, kinds=("container",), loss_share=0.5).toPandas()
    assert tight.groupby("container_id").loss_tokens.sum().max() <= 50
    assert packing.containers(docs.limit(0), limits).count() == 0
    assert packing.fill_report(packing.containers(docs, limits), limits).count() == 2


def test_water_filling():
    s = lambda name, share, cap, n: mixing.Share(name, share, cap, n)
    sources = [s("a", 0.5, 1, 100), s("b", 0.3, 1, 1000), s("c", 0.2, 5, 10), s("gone", 0.1, 3, 0)]
    assert mixing.exact_total(sources) == pytest.approx(200)
    exact = mixing.water_fill(sources, 200)
    assert exact == pytest.approx({"a": 100, "b": 60, "c": 40, "gone": 0})
    more = mixing.water_fill(sources, 600)
    assert more["a"] == 100 and more["c"] == 50 and more["b"] == pytest.approx(450)
    everything = mixing.water_fill(sources, 1e9)
    assert everything == {"a": 100, "b": 1000, "c": 50, "gone": 0.0}
    assert mixing.water_fill([], 5) == {} and mixing.exact_total([]) == 0.0


@needs_ranks
def test_mixture(spark):
    rows = [(i, "word " * (20 + i % 50), "en", ["A B", "a-b", "a_b "][i % 3], 1, "x") for i in range(600)] + [(1000 + i, "word " * 40, "en", "small", 1, "x") for i in range(40)] + [(5000, "other", "en", "nobody", 1, "x"), (5001, None, "en", "small", 1, "x"), (None, "x", "en", "small", 1, "x"), (5002, "x", None, None, 1, "x")]
    docs = spark.createDataFrame(rows, DOC)
    weights = spark.createDataFrame([("a_b", 0.7, 1), ("small", 0.2, 4), ("absent", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(docs, weights, full=False)
    shares = {r.source: r for r in report.collect()}
    used = mixed.toPandas()
    assert shares["absent"].tokens == 0
    assert shares["a_b"].actual_share == pytest.approx(0.7 / 0.9, abs=0.02) and shares["small"].actual_share == pytest.approx(0.2 / 0.9, abs=0.02)
    assert used[used.source == "small"].repeats.max() <= 4 and used[used.source == "a_b"].repeats.max() <= 1
    assert (used.n_tokens * used.repeats).sum() == sum(r.tokens for r in shares.values())
    again, _ = mixing.mixture(docs, weights, full=False)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    other, _ = mixing.mixture(docs, weights, seed=5, full=False)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, mixed.collect()))
    _, full = mixing.mixture(docs, weights)
    assert all(r.epochs <= r.max_repeats for r in full.collect())
    empty, none = mixing.mixture(docs.limit(0), weights)
    assert empty.count() == 0 and none.count() == 3


@needs_ranks
def test_a_scarce_source_does_not_shrink_the_registered_mixture(spark, tmp_path):
    rows = [(i, "word " * 50, "en", "plenty", 1, "x") for i in range(200)] + [(500 + i, "word " * 50, "en", "more", 1, "x") for i in range(200)] + [(900, "one short document", "en", "scarce", 1, "x"), (901, "word " * 5000, "en", "no place", 1, "x")]
    spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    weights = [("plenty", 0.5, 2), ("more", 0.46, 2), ("scarce", 0.04, 6), ("no place", 0.0, 3)]
    spark.createDataFrame(weights, "source string, target_share double, max_repeats int").coalesce(1).write.parquet(f"{tmp_path}/source_weights.parquet")
    report = {r.source: r for r in queries.p8_shares(spark, str(tmp_path)).collect()}
    available = sum(r.available_tokens for s, r in report.items() if s != "no_place")
    assert report["scarce"].epochs == 6 and report["no_place"].tokens == 0
    assert sum(r.tokens for r in report.values()) == pytest.approx(available, rel=0.02)
    # the excess goes to the others in proportion to their shares
    assert report["plenty"].tokens / report["more"].tokens == pytest.approx(0.5 / 0.46, rel=0.02)
    assert report["scarce"].actual_share < report["scarce"].target_share


def pages(rng):
    subjects, verbs, things = ["the team", "our vendor", "support", "the office"], ["has asked for", "is not sure about", "was told to change", "will move", "can see"], ["the plan", "a budget", "that report", "this list", "the review"]
    prose = lambda n: " ".join(f"{rng.choice(subjects).capitalize()} {rng.choice(verbs)} {rng.choice(things)} because we have to be done with it by the {rng.randrange(1, 28)}th." for _ in range(n))
    words = ["webcam", "headset", "planner", "desk", "cheap", "online"]
    rows, bad = [], set()
    for i in range(300):
        rows.append((i, prose(rng.randrange(2, 14))))
    for i in range(300, 330):
        bad.add(i)
        kind = i % 4
        n = rng.randrange(15, 60)
        rows.append((i, [lambda: " ".join(rng.choice(words) for _ in range(n)), lambda: "\n".join(f"https://shop{rng.randrange(99)}.example/p/{rng.randrange(999)}" for _ in range(n)), lambda: " ".join(f"#{rng.choice(words)}{rng.randrange(99)}" for _ in range(n)), lambda: prose(1) + "\n" + "\n".join(f"[{rng.choice(words)} {rng.choice(words)}](http://a{rng.randrange(99)}.example/x)" for _ in range(n))][kind]()))
    rows += [(400, None), (401, ""), (402, "ok"), (None, "webcam " * 50), (403, prose(3) + " See https://notes.example/d/1 for it."), (404, "The plan is late. " * 3000)]
    return rows, bad


def test_spam_pages(spark):
    rows, bad = pages(random.Random(4))
    docs = spark.createDataFrame([(i, t, None, "s", 1, "x") for i, t in rows], DOC)
    assert {r.doc_id for r in spam.spam_pages(docs).collect()} == bad
    assert spam.spam_pages(docs.limit(0)).count() == 0
    assert spam.spam_pages(docs.filter("text is null or text = ''")).count() == 0


def test_many_suspects_are_joined_with_the_same_result(spark, monkeypatch):
    rows, bad = pages(random.Random(4))
    docs = spark.createDataFrame([(i, t, None, "s", 1, "x") for i, t in rows], DOC)
    monkeypatch.setattr(spam, "SENT_SUSPECTS", 0)
    assert {r.doc_id for r in spam.spam_pages(docs).collect()} == bad


def test_curves_equal_a_plain_fit(spark):
    text = "a a a a b b c d the the is to for"
    docs = spark.createDataFrame([(1, text, None, None, 1, "x")], DOC)
    got = spam.page_curves(spam.with_texts(docs), {}).first()
    freq = [(4, 1, 1), (2, 2, 3), (1, 4, 8)]
    x = [np.log(np.sqrt(lo * hi)) for _, lo, hi in freq]
    y = [np.log(f) for f, *_ in freq]
    counts = sorted(spam.page_words(text).values(), reverse=True)
    assert counts == [4, 2, 2, 1, 1, 1, 1, 1]
    slope, cut = np.polyfit(x, y, 1)
    assert got.slope == pytest.approx(slope) and got.residual == pytest.approx(np.sqrt(np.mean((np.array(y) - slope * np.array(x) - cut) ** 2)))


def test_pools():
    cells = {("en", 3): 40, ("en", 4): 5, ("en", 6): 28, ("de", 2): 4, ("de", 9): 0, ("?", 3): 0}
    got = {(lang, band): {b for x, y, b in spam.pools(cells) if (x, y) == (lang, band)} for lang, band in cells}
    assert got == {("en", 3): {3}, ("en", 4): {3, 4}, ("en", 6): {4, 6}, ("de", 2): {2}, ("de", 9): {2}, ("?", 3): set()}


def test_wordy_sentences_do_not_excuse_half_a_page_of_labels():
    sentence = "It is what we have to do if you are to be with us when it is on, and that is not what I was for. "
    labels = "\n".join(f"Professional Ergonomic Keyboard Accessories {i}" for i in range(20))

    def share_of(text):
        return spam.unlike_prose(text, spam.overused(spam.page_words(text), {}), set()) / len(text)

    share = share_of(sentence * 6 + "\n" + labels)
    assert 0.5 < share == pytest.approx(len(labels) / (6 * len(sentence) + len(labels)), abs=0.05)
    assert share_of(sentence * 12 + "\n" + labels) == 0.0


def test_short_pages_count_by_what_they_show(spark):
    rows, _ = pages(random.Random(5))
    short = [(900, "https://a.example/x"), (901, "#deal #sale"), (902, "webcam cheap webcam cheap"), (903, "n/a"), (904, "tbd"), (905, "Kedzu weekly"), (905, "Kedzu weekly"), (906, "ok"), (906, "www.a.example www.b.example")]
    docs = spark.createDataFrame([(i, t, None, "s", 1, "x") for i, t in [r for r in rows if (r[0] or 0) < 300] + short], DOC)
    assert sorted(r.doc_id for r in spam.spam_pages(docs).collect()) == [900, 901, 902, 906]


def test_a_page_without_function_words_gets_the_language_it_fits():
    rates = spam.log_rates({"en": {"budget": 0.01, "plan": 0.02}, "de": {"haushalt": 0.01}})
    assert spam.language(spam.page_words("budget plan budget"), rates) == "en" and spam.language(spam.page_words("haushalt budge"), rates) == "de" and spam.language(spam.page_words("x"), {}) == "?"


def test_all_three_limits_of_a_container_bind(spark):
    rows = [(i, "prompt line\n" + "word " * (i % 37 + 1) if i % 3 else "x " * (i % 5 + 1), None, None, 1, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, DOC)
    limits = spark.createDataFrame([("container", 100, 0, "tokens")], "item_kind string, max_size long, overlap_size long, size_unit string")
    packed = packing.containers(docs, limits, kinds=("container",), max_segments=6, loss_share=0.8)
    use = packing.use_report(packed, limits, max_segments=6, loss_share=0.8).first()
    assert use.at_tokens > 0 and use.at_segments > 0 and use.at_loss > 0
    assert max(use.most_tokens, use.most_segments, use.most_loss) <= 1.0 and 0 < use.loss_use <= 1


@pytest.mark.parametrize("times", [1, 10])
def test_stuffed_pages_do_not_set_the_measure(spark, times):
    # most pages of this language and length are stuffed: their middle is not that of prose, on few pages or many
    rng = random.Random(8)
    curve = lambda i, prose, at: (i, 60, "en", prose, at + rng.random() / 10, 0.0 if prose else 0.9, -at - rng.random() / 10, 0.2 + rng.random() / 50)
    rows = [curve(i, i % 5 == 0, 5.0 if i % 5 == 0 else 8.0) for i in range(50 * times)]
    # a mixed page, prose by its function words, whose curve is that of the stuffed ones
    rows.append((9999, 60, "en", True, 8.05, 0.6, -8.05, 0.21))
    curves = spark.createDataFrame(rows, "doc_id long, n_words int, lang string, prose boolean, divergence double, share double, slope double, residual double")
    found = {r.doc_id for r in spam.suspects(curves).filter("extreme and share > 0.5").collect()}
    assert found == {i for i in range(50 * times) if i % 5} | {9999}
