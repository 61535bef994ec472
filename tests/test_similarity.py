"""The measure of similarity against difflib, and its time."""

import difflib
import random
import time

from corpusloom.operators import similarity as S


def slow(a, b):
    return round(difflib.SequenceMatcher(None, a, b).ratio(), 4)


def test_equals_difflib():
    rnd = random.Random(7)
    alphabets = ["ab", "abcd", "abcdefghijklmnopqrstuvwxyz ", "aaaaaaaaabcdefgh", "é日𝔸b" + "abc " * 20, "".join(chr(200 + k) for k in range(150))]
    for _ in range(1500):
        al, (la, lb) = rnd.choice(alphabets), rnd.choice([(5, 5), (30, 40), (150, 199), (300, 200), (600, 450), (500, 100), (0, 5)])
        a, b = ("".join(rnd.choice(al) for _ in range(rnd.randrange(n + 1))) for n in (la, lb))
        for _ in range(rnd.randrange(4)):
            s, p = rnd.randrange(len(a) + 1), rnd.randrange(len(b) + 1)
            b = b[:p] + a[s : s + rnd.randrange(60)] + b[p:]
        assert S.similar(a, b) == slow(a, b), (a, b)


def test_takes_a_small_part_of_difflib_s_time():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("etaoinshrdlucmfw", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 1, 1, 1, 1, 1], k=rnd.randrange(2, 9))) for _ in range(400)]
    pairs = [tuple(" ".join(rnd.choices(words, k=2000))[:8000] for _ in range(2)) for _ in range(4)]
    start = time.process_time()
    want = [slow(a, b) for a, b in pairs]
    half = time.process_time()
    assert [S.similar(a, b) for a, b in pairs] == want
    assert time.process_time() - half < (half - start) / 4


def test_long_texts_are_compared_whole(spark):
    """What differs behind the first 8000 characters counts, in either text."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    head, tail = text(1500), text(900)
    rows = [(1, head + " " + tail, head + " " + text(900)), (2, head, head + " " + tail), (3, head + " " + tail, head), (4, head + " " + tail, head.upper() + "\n\n" + tail), (5, head, None)]
    assert len(head) > 8000
    got = {r["id"]: (r["similarity"], r["abnormal"]) for r in S.compare(spark.createDataFrame(rows, "id int, a string, b string"), "a", "b").select("id", "similarity", "abnormal").collect()}
    want = {i: slow(a, " ".join((b or "").lower().split())) for i, a, b in rows}
    assert got == {i: (s, s < 0.92) for i, s in want.items()}
    assert got[1][1] and got[2][1] and got[3][1] and got[4] == (1.0, False)


def test_pairs_of_places_are_held_some_at_a_time(monkeypatch):
    rnd = random.Random(5)
    line = [chr(0x4E00 + k) for k in range(120)]
    texts = ["".join("".join(line[p : p + 20]) for p in rnd.choices(range(0, 120, 20), k=60)) for _ in range(6)] + ["", "ab"]
    monkeypatch.setattr(S, "PAIRS", 50)
    for a in texts:
        for b in texts[3:]:
            assert S.similar(a, b) == slow(a, b)
