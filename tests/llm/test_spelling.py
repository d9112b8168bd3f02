import collections
import random
import re
import zlib

from maskwell.llm import spelling


def by_hand(rows, shortest=6, least=5, factor=5):
    """The contract by comparing all words."""
    count = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= least}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= factor * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def edited(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abÿé×") + word[at + 1 :], word[:at] + rng.choice("abcZ") + word[at:], word[:at] + word[at] + word[at:]])


def corpus(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé", k=rng.randint(5, 9))) for _ in range(25)]
    bag = []
    for w in base:
        bag += [w] * rng.choice([5, 25, 125, 700])
        for _ in range(4):
            v = edited(rng, w)
            bag += [v] * rng.choice([5, 6, 25])
            bag += [edited(rng, v)] * 5
    rng.shuffle(bag)
    return [(k, rng.choice([" ", "-", "1", "\n", "Ā"]).join(bag[k * 30 : k * 30 + 30])) for k in range(len(bag) // 30 + 1)]


def got(docs, **more):
    return {tuple(r) for r in spelling.variants(docs, **more).collect()}


def test_variants_equal_all_pairs(spark):
    rows = [*corpus(), (9000, None), (9001, ""), (9002, "x" * 300 + " " + "y" * 70), (None, "ABCDEF ÀBCDEF " * 40)]
    docs = spark.createDataFrame([(a, b, "w", 1) for a, b in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = by_hand(rows)
    assert got(docs) == want
    assert sum(w[1] is not None for w in want) > 40 and any(w[1] is not None and w[1] != w[2] for w in want)


def test_runs_end_with_their_texts(spark):
    rows = [(k, "abcdef") for k in range(6)] + [(10 + k, "gh") for k in range(6)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == by_hand(rows)


def test_ties_and_doubled_letters(spark):
    rows = [(1, "aabbcc " * 30 + "aabbc " * 30 + "abbcc " * 5 + "aabbca " * 6 + "aaabbcc " * 5)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_chains_of_forms(spark):
    text = " ".join(f"{'abcdefgh'[:8 - k]}{'z' * k} " * 5 ** (5 - k) for k in range(5))
    rows = [(1, text)]
    want = by_hand(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert {w[2] for w in want} == {"abcdefgh"}


def test_empty_tables(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == set()
    assert got(spark.createDataFrame([(1, None)], "doc_id long, text string")) == set()


def test_a_text_beyond_a_slice(spark):
    from maskwell.llm import textkit

    rows = [(1, "quickly quickli brownish foxhound " * (textkit.SLICE_BYTES // 30)), (2, "quicklyy " * 9)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)
