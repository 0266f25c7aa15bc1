import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegraph.llm import abuse as ab
from lodegraph.llm.boosting import BoostedTrees, Isotonic

DOC = "doc_id bigint, text string, source string, score string"
LAB = "doc_id bigint, rater string, quality int, toxic int, labelled_at string"


@pytest.mark.parametrize(
    ("disguised", "plain"),
    [
        ("you іdіоt", "you idiot"), ("fu\u200bck you", "fuck you"), ("what an 1d10t", "what an idiot"), ("f**k this", "fuck this"), ("an i d i o t", "an idiot"),
        ("t-i-t-s", "tits"), ("fuuuuuck", "fuck"), ("dumb455", "dumbass"), ("ｉｄｉｏｔ", "idiot"), ("l.o.s.e.r", "loser"), ("i@@@t", "idiot"),
    ],
)
def test_disguises_are_undone(disguised, plain):
    got, n = ab.undisguised(disguised)
    assert plain in got and (n >= 1 or not disguised.isascii())


@pytest.mark.parametrize(
    ("disguised", "plain"),
    [("you dumb a$$", "ass"), ("kick your a$$!", "ass!"), ("you dumba$$", "dumbass"), ("such idiot$", "idiots"), ("ki||", "kill"), ("what an @$$", "ass")],
)
def test_words_that_end_in_signs(disguised, plain):
    for text in (disguised, f"{disguised} x@y.org", f"@name {disguised}"):
        got, n = ab.normalised(text)
        assert plain in got and n == 1


def test_marks_behind_a_plain_word_are_no_disguise():
    for text in ("what an idiot!", "idiot!! go", "|idiot|fool|", "bitch|"):
        assert ab.normalised(text) == (text, 0)


def test_ordinary_text_is_left_alone():
    for text in ("x ** y and *args, **kwargs", "a b c d e", "sha1 deadb33f 0x1f", "Привет, как дела", "see a-b-c for it", "aaa bbb"):
        assert ab.normalised(text) == (text.lower(), 0) and ab.undisguised(text)[1] == 0


def test_features_see_one_sentence_in_a_long_text():
    filler = "The parser drops the token when the hint is missing. " * 2000
    i = ab.FEATURES.index("worst")
    alone, hidden = ab.features("You stupid idiot, learn to read."), ab.features(filler + "You stupid idiot, learn to read. " + filler)
    assert hidden[i] == alone[i] > ab.features(filler)[i] == 0
    assert len(alone) == ab.N_FEATURES and np.isfinite(hidden).all()


PHRASE_TOTAL = ab.FEATURES.index("phrase_total")


@pytest.mark.parametrize(
    "text",
    [
        "They should be hanged.", "Nobody will miss him.", "Better off without him.", "What a waste of air.", "Nobody respects her.", "It makes me vomit.",
        "Go to hell.", "Rot in hell.", "Drink bleach.", "Hired him? Should be beaten.", "Bent over.", "They are filth.",
    ],
)
def test_phrases_without_a_second_person_or_strong_word_are_found(text):
    assert ab.features(text)[PHRASE_TOTAL] > 0


@settings(max_examples=600, deadline=None, derandomize=True)
@given(st.sampled_from([(k, p) for k, v in ab.PHRASES.items() for p in v]).flatmap(lambda kp: st.tuples(st.just(kp[0]), st.from_regex(kp[1], fullmatch=True))))
def test_every_phrase_opens_its_gate(sample):
    _, text = sample
    for sentence in ab._SENTENCE.split(ab.normalised(text)[0]):
        words, found, _ = ab.plain_words(ab._WORD.findall(sentence))
        assert ab.phrase_counts(words, found) == [len(p.findall(" ".join(words))) for p in ab._PHRASES.values()]


def labelled(spark):
    bad = ["You are a moron.", "Kill yourself, loser.", "Women cannot think and should be kept out.", "Suck my dick tonight.", "I know where you live, watch your back."]
    good = ["Kill the child process.", "This crappy build is slow.", "The code of conduct bans insults.", "Please review the patch.", "The master sends the slave a page."]
    docs = [(i, bad[i % 5] if i % 2 else good[i % 5], "s" if i % 3 else None, "x") for i in range(120)]
    labels = [(i, "r", 3, i % 2, "t") for i in range(100)] + [(0, "r", 3, None, "t"), (1, "q", 1, 1, "t"), (1, "q", 1, 1, "t"), (None, "q", 1, 1, "t")]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LAB)


#: Families of abuse of which no word is in a lexicon: they can only be learned.
FAMILIES = {
    "hooves": ["Did {} type this with hooves again?", "Surely {} typed it with hooves."],
    "lamp": ["The lamp burns longer than {} think.", "My lamp burns longer than what {} think."],
    "gravel": ["Gravel outclasses {} any day.", "Even wet gravel outclasses {}."],
}
CARRIERS = ["The parser drops token {n} when the hint is missing.", "Export {n} rows to the cache.", "Line {n} refers to the old table.", "Why does stage {n} need a port at all?"]


def family_documents(n, families, clean_every=2):
    docs, truth = [], {}
    names = sorted(families)
    for i in range(n):
        body = [CARRIERS[(i + k) % 4].format(n=i * 7 + k) for k in range(3)]
        truth[i] = i % clean_every == 0
        if truth[i]:
            f = FAMILIES[names[i // clean_every % len(names)]]
            body.insert(i % 4, f[i // 8 % 2].format("they" if i % 5 else "these people"))
        docs.append((i, " ".join(body), "s", "x"))
    return docs, truth


def test_phrases_are_learned_from_labels(spark):
    """No word of these passages is listed; labels with ten per cent of errors are enough to find them elsewhere."""
    docs, truth = family_documents(400, FAMILIES)
    labels = [(i, "r", 3, int(t != (i % 10 == 3)), "t") for i, t in truth.items()]
    model = ab.fit_model(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LAB))
    fresh, want = family_documents(600, FAMILIES, 3)
    got = {r["doc_id"]: r["flagged"] for r in ab.abuse_scores(spark.createDataFrame([(i, t.replace("cache", "store"), a, b) for i, t, a, b in fresh], DOC), model).collect()}
    found = sum(got[i] and want[i] for i in want)
    assert found >= 0.95 * sum(want.values()) and found >= 0.95 * sum(got.values())
    assert any("hooves" in g for g in model.grams) and not any(g in ("the", "parser drops") for g in model.grams)


def test_a_family_that_no_label_shows(spark):
    """Labels show two families; of the third only what the lexicons know is found, and nothing else is flagged for it."""
    known = {k: v for k, v in FAMILIES.items() if k != "gravel"}
    docs, truth = family_documents(400, known)
    model = ab.fit_model(spark.createDataFrame(docs, DOC), spark.createDataFrame([(i, "r", 3, int(t), "t") for i, t in truth.items()], LAB))
    texts = {1: "Gravel outclasses them any day.", 2: "Export 7 rows. You worthless idiot. Line 8 refers to the old table.", 3: "Line 3 refers to the old table.", 4: "Go kill yourself, loser."}
    got = {r["doc_id"]: r["flagged"] for r in ab.abuse_scores(spark.createDataFrame([(k, t, "s", "x") for k, t in texts.items()], DOC), model).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_near_copies_count_once(spark):
    """A passage that only copies of one mislabelled document hold is not learned."""
    copies = [(i, f"The zebra index is stale. Its quokka column is null. See page {i}. Nothing else.", "s", "x") for i in range(6)]
    docs, truth = family_documents(200, FAMILIES)
    labels = [(i + 1000, "r", 3, 1, "t") for i in range(6)] + [(i, "r", 3, int(t), "t") for i, t in truth.items()]
    model = ab.fit_model(spark.createDataFrame([(i + 1000, *r) for i, *r in copies] + docs, DOC), spark.createDataFrame(labels, LAB))
    assert not any("zebra" in g or "quokka" in g for g in model.grams)


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = ab.fit_model(docs, labels)
    fresh = {1: "You pathetic idiot.", 2: "Shut up the logger.", 3: None, 4: "", 5: "   ", 6: "Go fuck yourself.", 7: "The naked pointer is freed.", 8: "你这个白痴，滚。", 9: "x" * 200_000}
    got = {r["doc_id"]: (r["score"], r["flagged"]) for r in ab.abuse_scores(spark.createDataFrame([(k, t, None, "") for k, t in fresh.items()], DOC), model).collect()}
    assert {k for k, (_, f) in got.items() if f} == {1, 6, 8}
    assert got[3][0] == got[4][0] == got[5][0] == 0 and all(0 <= s <= 1 for s, _ in got.values())


def test_no_labels_and_no_documents(spark):
    docs, labels = labelled(spark)
    none = ab.fit_model(docs, labels.limit(0))
    assert [r["flagged"] for r in ab.abuse_scores(docs, none).collect()] == [False] * 120
    assert ab.abuse_scores(docs.limit(0), none).collect() == []


def test_votes_and_rates(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: (r["y"], r["n"]) for r in ab.votes(labels).collect()}
    assert got[1] == (1.0, 2) and got[0] == (0.0, 1) and None not in got
    scores = spark.createDataFrame([(i, 0.9 if i < 30 else 0.1, i < 30) for i in range(120)], "doc_id bigint, score double, flagged boolean")
    rates = {r["source"]: (r["n_documents"], r["n_flagged"]) for r in ab.source_rates(docs.unionByName(docs), scores).collect()}
    assert rates == {None: (40, 10), "s": (80, 20)}


def test_trees_learn_an_interaction_and_isotonic_is_monotone():
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = BoostedTrees().fit(x[:2000], y[:2000], np.ones(2000))
    assert ((t.decision(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    iso = Isotonic.fit(np.array([3.0, 1, 2, 4, 5]), np.array([1.0, 0, 1, 0, 1]), np.ones(5))
    out = iso(np.linspace(0, 6, 50))
    assert (np.diff(out) >= 0).all() and out[0] == 0 and out[-1] == 1
