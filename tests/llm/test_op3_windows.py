"""License scans: what matches in a text depends on that text alone, and misses next to nothing."""

import random
import re

import pytest

from sparrel.llm import license_scan

ALL = license_scan.TEMPLATES | license_scan.NOTICES | license_scan.whole_texts()


def shingles_of(text):
    w = license_scan.plain(re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def prose(r, n):
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 7))) for _ in range(n))


SETS = {n: shingles_of(t) for n, t in ALL.items()}


def held(text, names=None):
    s = shingles_of(text)
    return {n for n in names or ALL if 100 * len(SETS[n] & s) >= 75 * len(SETS[n])}


@pytest.fixture(scope="module")
def cut_texts():
    """Every template cut at its end, its start or both, to what still holds three quarters; some with neighbours."""
    r = random.Random(4)
    rows = []
    for name, text in ALL.items():
        words = text.split()
        for share in (0.76, 0.8, 0.9, 1):
            n = -(-len(words) * share // 1)
            at = r.choice([0, len(words) - int(n), r.randint(0, len(words) - int(n))])
            rows.append((len(rows), " ".join(words[at : at + int(n)])))
            rows.append((len(rows), prose(r, r.randint(0, 9)) + " " + " ".join(words[at : at + int(n)]) + " " + prose(r, r.randint(0, 9))))
    return rows


def test_cut_templates_match_alone(cut_texts):
    """The bare retrieval, one text at a time, against exact containment."""
    scanner = license_scan._default()
    from sparrel.llm.shingles import core_words, shingle

    wanted = missed = 0
    for _, text in cut_texts:
        words, at, _ = core_words([text])
        got = {scanner.names[k] for _, k in scanner._retrieve(shingle(words, license_scan.SHINGLE), at)}
        want = held(text)
        wanted += len(want)
        missed += len(want - got)
    assert wanted > 500 and missed <= 0.001 * wanted


def test_same_rows_for_any_partitioning(spark, cut_texts):
    r = random.Random(9)
    rows = [*cut_texts, (None, ""), (7, None), (8, "one two"), *cut_texts[:5]]

    def found(some, parts):
        d = spark.createDataFrame(some, "doc_id long, text string").repartition(parts)
        return sorted(map(tuple, license_scan.license_scan(d).collect()))

    want = found(rows, 1)
    mixed = r.sample(rows, len(rows))
    assert found(mixed, 1) == want and found(mixed, 50) == want
    alone = [tuple(x) for x in want if x[0] is not None]
    one = dict(rows)
    for doc in r.sample(sorted(one, key=str), 20):
        if one[doc] and sum(d == doc for d, _ in rows) == 1:
            assert found([(doc, one[doc])], 1) == [x for x in alone if x[0] == doc]


def test_random_words_between(spark):
    """Templates with words put in, left out or changed, inside longer texts: the same as exact containment."""
    r = random.Random(12)
    names = [n for n in ALL if len(ALL[n].split()) < 600]
    scanner = license_scan.Scanner({n: ALL[n] for n in names})
    wanted = missed = 0
    for _ in range(400):
        words = ALL[r.choice(names)].split()
        for _ in range(r.randint(0, max(1, len(words) // 20))):
            k, kind = r.randrange(len(words)), r.random()
            words[k : k + (kind > 0.3)] = ["zz" + str(r.randrange(99))] if kind < 0.7 else []
        text = prose(r, r.randint(0, 200)) + " " + " ".join(words) + " " + prose(r, r.randint(0, 200))
        from sparrel.llm.shingles import core_words, shingle

        w, at, _ = core_words([text])
        got = {scanner.names[k] for _, k in scanner._retrieve(shingle(w, license_scan.SHINGLE), at)}
        want = held(text, names)
        wanted += len(want)
        missed += len(want - got)
    assert wanted > 150 and missed <= 0.001 * wanted


def test_templates_from_a_table(spark):
    own = spark.createDataFrame([("mine", "one two three four five six seven"), (None, "x"), ("none", None)], "license string, text string")
    odd = spark.createDataFrame([(1, "L", "so: One two, three four five six. seven eight"), (2, "L", "one two three four")], "doc_id long, license string, text string")
    got = license_scan.license_scan(odd, own).collect()
    assert [(g["doc_id"], g["license"], g["n_shared"]) for g in got] == [(1, "mine", 3)]
    assert license_scan.template_table(spark).count() == len(ALL)


def test_very_long_text_and_many_short_ones(spark):
    r = random.Random(3)
    text = ALL["MIT-text"]
    rows = [(0, prose(r, 200_000) + " " + text)] + [(k, w) for k, w in enumerate(text.split(), 1)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(g["doc_id"], g["license"]) for g in got} >= {(0, "MIT-text")}
    assert all(g["doc_id"] == 0 or g["license"].endswith("-named") for g in got)
