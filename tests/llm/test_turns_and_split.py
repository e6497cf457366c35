import datetime as dt
import random

import pytest

from notewarp.llm import split, turns
from notewarp.llm.names import distance, parts

SEG = "segment_id long, note_id string, speaker struct<source:string,diarization_label:string,name:string>, text string, start_time timestamp, end_time timestamp, voice string"
T = dt.datetime(2026, 7, 15, 9)


def seg(i, text, source="microphone", label=None, name=None, at=None, note="n"):
    start = None if at == "none" else T + dt.timedelta(seconds=i if at is None else at)
    return (i, note, (source, label, name), text, start, start and start + dt.timedelta(seconds=1), "clash")


def found(spark, rows):
    got = turns.speaker_turns(spark.createDataFrame(rows, SEG)).orderBy("note_id", "turn_no").collect()
    return [(r.first_segment_id, r.last_segment_id) for r in got], got


def test_labels_names_and_channels(spark):
    rows = [
        seg(1, "[00:01] Speaker 3: erm, hello there"),
        seg(2, "more of it", label="spk_3"),
        seg(3, "uh... [music]", label="1"),
        seg(4, "I am one", label="Speaker 1", name="Pavel Trenbrivatro"),
        seg(5, "still me", name="TRENBRIVATRO, PAVEL"),
        seg(6, "and me (laughs)", label="SPEAKER_1"),
        seg(7, ">> P. Trenbrivatro: and again"),
        seg(8, "hello there", label="3"),
        seg(9, "hmm"),
        seg(10, ""),
        seg(11, None),
    ]
    pairs, got = found(spark, rows)
    assert pairs == [(1, 2), (4, 7), (8, 8)]
    assert got[0].text == "hello there more of it" and got[1].speaker == "Pavel Trenbrivatro" and got[0].speaker == "Speaker 3"


def test_unlabelled_segments_by_channel(spark):
    rows = [seg(1, "first words"), seg(2, "named words", name="Olga Ralmapomro"), seg(3, "far away", source="speaker"), seg(4, "far again", source="speaker"), seg(5, "mine again"), seg(6, "alone", note="m"), seg(7, "other", source="speaker", note="m")]
    assert found(spark, rows)[0] == [(6, 6), (7, 7), (1, 2), (3, 4), (5, 5)]


def test_redelivered_ties_and_nulls(spark):
    rows = [seg(5, "Same  text", at=1, label="1"), seg(2, "same text", at=1, label="1"), seg(3, "other", at=1, label="1"), seg(4, "late", at=0, label="2"), seg(9, "no time", at="none", label="2"), seg(1, "lost", note=None)]
    assert found(spark, rows)[0] == [(4, 4), (2, 3), (9, 9)]
    assert found(spark, [])[0] == []
    long = "word " * 50_000
    assert found(spark, [seg(1, long, label="1"), seg(2, "x" * 100_000, label="1")])[0] == [(1, 2)]


def test_hidden_markov_model_tells_two_people_on_one_microphone(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 3)
    rows, i = [], 0
    for block in range(6):
        who, text = ("Ana Uno", "el proyecto está en la mesa y no es para la junta {}") if block % 2 else ("Bob Two", "The plan is on the table and that is not for the board {}.")
        for k in range(8):
            i += 1
            rows.append(seg(i, text.format(i), name=who if k < 5 else None))
    pairs, _ = found(spark, rows)
    assert pairs == [(1 + 8 * b, 8 + 8 * b) for b in range(6)]


def test_names():
    assert parts(" Trenbrivatro,  Pavel ") == ("pavel", "trenbrivatro") and parts("Dr Zoë Parnividzu (Corvex)") == ("zoe", "parnividzu") and parts("olga.ralmapomro") == ("olga", "ralmapomro")
    assert parts("") == () and (distance("abcd", "abdc"), distance("abc", "xyz", 2), distance("", "ab")) == (1, 3, 2)


def random_text(rng, n):
    return "".join(rng.choice(["Lorem ipsum", " ", ". ", "\n", "\n\n", ", ", "x" * rng.randrange(1, 90), "ß", "🚀"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    text, size, overlap = random_text(rng, 400), rng.randrange(40, 200), rng.randrange(0, 30)
    pieces = split.split_text(text, size, overlap)
    assert [s for s, *_ in pieces] == [0] + [e for _, e, *_ in pieces[:-1]] and pieces[-1][1] == len(text)
    for i, (s, e, _, t) in enumerate(pieces):
        assert len(t) <= size and t == text[max(0, s - overlap) : e]
        if i:
            assert t[: min(overlap, s)] == text[max(0, s - overlap) : s]


def test_natural_boundaries_come_first():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven."
    assert [text[s:e] for s, e, *_ in split.split_text(text, 34, 0)] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven."]
    assert split.split_text("", 10, 2) == [] and split.split_text("short", 10, 2) == [(0, 5, split.PARAGRAPH, "short")]
    assert all(k == split.INSIDE for *_, k, _ in split.split_text("x" * 100, 30, 5)[1:])
    with pytest.raises(ValueError):
        split.split_text("abc", 5, 5)


def brute_merge(text, room):
    parts_ = [list(p) for p in split.atoms(text, room)]
    while True:
        options = [(parts_[i][2], parts_[i][1] - parts_[i - 1][0], parts_[i][0], i) for i in range(1, len(parts_)) if parts_[i][1] - parts_[i - 1][0] <= room]
        if not options:
            return [tuple(p) for p in parts_]
        i = min(options)[3]
        parts_[i - 1][1] = parts_[i][1]
        del parts_[i]


@pytest.mark.parametrize("seed", range(6))
def test_heap_equals_brute_force(seed):
    text = random_text(random.Random(seed), 80)
    assert split.merged(text, 70) == brute_merge(text, 70)


def test_items_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(split, "BLOCK_CHARS", 200)
    notes = spark.createDataFrame([("a", 1, T, "old " * 50), ("a", 2, T, "new"), ("b", 3, T, "w" * 30 + " x"), ("c", 4, T, None), (None, 5, T, "y" * 99)], "id string, detail_no long, updated_at timestamp, summary_text string")
    rows = [seg(i, f"sentence number {i} of the talk.", at=i * 400) for i in range(60)] + [seg(100, "tiny", note="z")]
    limits = spark.createDataFrame([("summary", 20, 4, "characters"), ("transcript", 100, 10, "characters"), ("other", 1, 0, "x")], "item_kind string, max_size long, overlap_size long, size_unit string")
    segs = spark.createDataFrame(rows, SEG)
    report = {(r.note_id, r.item_kind): r for r in split.split_report(notes, segs, limits).collect()}
    assert {k: r.cut_kind for k, r in report.items()} == {("b", "summary"): "inside_word", ("n", "transcript"): "natural"}
    whole = "\n".join(r[3] for r in rows[:60])
    pieces = split.pieces(notes, segs, limits).filter("note_id = 'n'").orderBy("core_start").collect()
    assert "".join(whole[p.core_start : p.core_end] for p in pieces) == whole
    assert all(p.text == whole[max(0, p.core_start - 10) : p.core_end] and len(p.text) <= 100 for p in pieces)
    assert split.split_report(notes.limit(0), segs.limit(0), limits).count() == 0


def test_block_edges_change_nothing(spark):
    rng = random.Random(11)
    rows = [seg(i, "".join(rng.choice(["Lorem ipsum", " ", ". ", ", ", "\n\n", "x" * rng.randrange(1, 130), "ß🚀"]) for _ in range(rng.randrange(1, 12))) or "-", at=i * 400) for i in range(300)]
    segs = spark.createDataFrame(rows, SEG)
    notes = spark.createDataFrame([], "id string, detail_no long, updated_at timestamp, summary_text string")
    limits = spark.createDataFrame([("transcript", 120, 25, "characters")], "item_kind string, max_size long, overlap_size long, size_unit string")
    whole = sorted(map(tuple, split.pieces(notes, segs, limits, block_chars=10**9).collect()))
    assert len(whole) > 100
    for chars in (150, 400, 3000):
        assert sorted(map(tuple, split.pieces(notes, segs, limits, block_chars=chars).collect())) == whole


def test_a_word_that_fits_a_piece_is_whole_in_one():
    text = "start " + "w" * 95 + " end " + "v" * 101 + " x"
    got = split.split_text(text, 100, 10)
    assert any("w" * 95 in t for *_, t in got) and not any("v" * 101 in t for *_, t in got)
    assert [k for _, _, k, _ in got if k == split.INSIDE] and all(len(t) <= 100 for *_, t in got)
    natural = split.split_text("start " + "w" * 95 + " end", 100, 10)
    assert all(k != split.INSIDE for _, _, k, _ in natural) and any(k == split.SHARED for _, _, k, _ in natural)
    assert all(k != split.INSIDE for _, _, k, _ in split.split_text("a" + " " * 500 + "b", 100, 10))


def test_parts_of_a_long_stretch_are_decoded_as_one():
    import numpy as np

    rng = random.Random(3)
    voices = ["Na", "Nb", "-speaker"]
    traits = [{"voice": v, "trait": t, "n": rng.randrange(1, 9)} for v in voices[:2] for t in ("len", "lde", "fT", "fF")]
    moves = [{"a": a, "b": b, "n": rng.randrange(1, 9)} for a in voices[:2] for b in voices[:2]]
    model = turns.SpeakerModel(voices, traits, moves)
    profiles = ["|".join((rng.choice(["len", "lde"]), rng.choice(["fT", "fF"]))) for _ in range(23)]
    sources = [rng.choice(["microphone", "microphone", "speaker"]) for _ in profiles]
    emitted = model.emissions(sources, profiles)
    whole = model.path(emitted, model.after("Na"), model.before("Nb"))
    assert all((model.states[i] == "-speaker") == (s == "speaker") for i, s in zip(whole, sources))
    bits = [emitted[i : i + 5] for i in range(0, 23, 5)]
    got, fixed = [], lambda at: np.where(np.arange(3) == at, 0.0, -1e12)
    for part, (a, b) in zip(bits, model.ends([model.through(p) for p in bits], "Na", "Nb")):
        got += model.path(part, fixed(a), fixed(b))
    score = lambda path: model.after("Na")[path[0]] + emitted[range(23), path].sum() + sum(model.between[a, b] for a, b in zip(path, path[1:])) + model.before("Nb")[path[-1]]
    assert score(got) == pytest.approx(score(whole))
    # transitions are those of the note
    one = turns.SpeakerModel(["Na", "Nb"], [], [{"a": "Na", "b": "Nb", "n": 50}, {"a": "Nb", "b": "Na", "n": 50}])
    assert one.move("Na", "Nb") > one.move("Na", "Na")


@pytest.mark.parametrize("block", [3, 2000])
def test_the_model_recovers_held_out_labels(spark, block):
    rng = random.Random(2)
    who = [("Ana Uno", "el proyecto está en la mesa y no es para la junta"), ("Bob Two", "The plan is on the table and that is not for the board."), ("Cid Tres", "das ist nicht für mich und wir")]
    rows, truth, at = [], {}, 0
    for i in range(240):
        if i % 6 == 0:
            at = rng.randrange(3)
        truth[i] = at
        rows.append(seg(i, f"{who[at][1]} {i}", name=None if i % 4 == 1 and i > 12 or 100 <= i < 112 else who[at][0]))
    got = {r.segment_id: r.voice for r in turns.voiced_segments(spark.createDataFrame(rows, SEG), block=block).collect()}
    hidden = [i for i in truth if rows[i][2][2] is None]
    right = sum(got[i] == "N" + who[truth[i]][0].lower() for i in hidden)
    assert len(got) == 240 and right >= 0.95 * len(hidden)


def test_the_model_joins_a_label_and_a_name_that_never_meet(spark):
    said = {"a": "The plan is on the table {}.", "b": "el proyecto está en la mesa {}", "c": "das ist nicht für mich und wir {}"}
    forms = {"a": [("a", "Ana Uno"), ("a", None), (None, "Ana Uno")], "b": [("b", None), (None, "Bob Two")], "c": [("c", "Cid Tres"), (None, "Cid Tres"), ("c", None)]}
    # the other note's label and name are two people's, who speak much and unalike
    others = {"a": ("a", "Ana Uno"), "b": ("b", None), "c": (None, "Dan Four")}
    rows, i = [], 0
    for who in "acbacaabca":
        for k in range(2 if who == "b" else 4):
            i += 1
            rows.append(seg(i, said[who].format(i), label=forms[who][k % len(forms[who])][0], name=forms[who][k % len(forms[who])][1], note="one"))
    for k in range(40):
        who = "acbacbabcb"[k // 4]
        rows.append(seg(100 + k, said[who].format(k), label=others[who][0], name=others[who][1], note="two"))
    # without a label and a name on one segment nothing says that both are written of one voice
    rows += [seg(201, "The plan", label="1", note="unsaid"), seg(202, "The plan too", name="Ana Uno", note="unsaid")]
    # nor is one segment of each enough
    rows += [seg(301, "The plan", label="1", name="Ana Uno", note="thin"), seg(302, "The plan too", label="2", note="thin"), seg(303, "The plan is", name="Bob Two", note="thin")]
    got = {"one": [], "two": [], "unsaid": [], "thin": []}
    for r in turns.speaker_turns(spark.createDataFrame(rows, SEG)).orderBy("note_id", "turn_no").collect():
        got[r.note_id].append((r.first_segment_id, r.last_segment_id))
    assert got["one"] == [(1, 4), (5, 8), (9, 10), (11, 14), (15, 18), (19, 26), (27, 28), (29, 32), (33, 36)]
    assert got["two"] == [(100 + 4 * b, 103 + 4 * b) for b in range(10)]
    assert got["unsaid"] == [(201, 201), (202, 202)] and got["thin"] == [(301, 301), (302, 302), (303, 303)]


def test_what_has_one_possible_voice_is_left_to_no_model(spark, monkeypatch):
    def never(*_):
        raise AssertionError("nothing is open")

    monkeypatch.setattr(turns, "inferred", never)
    rows = [seg(1, "named words", name="Olga Ralmapomro"), seg(2, "mine"), seg(3, "far", source="speaker"), seg(4, "alone", note="m"), seg(5, "where", source=None, note="m")]
    got = {r.segment_id: r.voice for r in turns.voiced_segments(spark.createDataFrame(rows, SEG)).collect()}
    assert got == {1: "Nolga ralmapomro", 2: "Nolga ralmapomro", 3: "-speaker", 4: "-microphone", 5: "-?"}
