"""The ten operators and the pipeline against brute force, round trips or held-out pages."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrel.llm import common, encode, exact_dedup, html_blocks, html_extract, html_pages, license_scan, near_dedup, packing, pieces, quality, sharding, shingles, token_counts, token_file

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SPACES = "[\x20\x09-\x0d]+"
#: Other columns, with names that clash with those of the operators.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("digest", T.StringType()),
    T.StructField("node", T.LongType()), T.StructField("n_words", T.StringType()), T.StructField("size", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("Words", T.StringType()),
])


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def corpus(seed=1, n=120):
    """Texts with copies, near copies, empty ones, nulls, ties and one very long text."""
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 120)) for _ in range(n)]
    base = prose(r, 150)
    for k in range(30):
        words = base.split(" ")
        for _ in range(k // 6):
            words[r.randrange(len(words))] = "zz" + str(r.randrange(99))
        texts.append(" ".join(words))
    texts += [base, base.replace(" ", "  "), base.upper(), "", " ", "\n\t", "one", "One", "one two three", None, None, "x " * 30, prose(r, 20000), "  a  \n b\t\tc !\x1c! x y don't", "日本語 текст ☃ 😀"]
    rows = [(k, t, f"h{k % 5}") for k, t in enumerate(texts)]
    rows += [(3, texts[3], "h0"), (3, texts[3], "h0"), (5, "another text of the same number", "h1"), (None, texts[7], "h2"), (None, None, None), (9000, "no host at all " * 4, None)]
    return [(*row, "d", 1, "w", 2, 3, "W") for row in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(4, "size", "text").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def reference(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "byte")])
def test_chunks_give_the_ids_of_whole_texts(path, kind, monkeypatch):
    monkeypatch.setattr(encode, "CACHE_CHARS", 3000)
    enc, ids_of = encode.ChunkEncoder(path, kind), reference(path)
    r = random.Random(5)
    odd = ["a", "É", " ", "  ", "\n", "'s", "'", "12", "|", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "...", "ß", "\x1c", " ", "\xa0", "İ", "ΑΣ", "ﬁ", "é", "\U0001f600", "x|y", "µ", "Ÿ", "ª"]
    texts = ["".join(r.choice(odd) for _ in range(r.randint(0, 30))) for _ in range(400)] + [t for _, t, *_ in corpus() if t]
    for a, b in encode.text_slices(texts, 500):
        ids, ends = enc.encode(texts[a:b])
        for t, got in zip(texts[a:b], np.split(ids, ends[:-1]), strict=True):
            assert got.tolist() == ids_of(t), t


def test_op1_segments():
    r = np.random.default_rng(3)
    for high in (1, 200, 70000, 1 << 30):
        ids = r.integers(0, high, 5000).astype(np.uint32)
        ends = np.sort(r.integers(0, 5001, 40))
        ends[-1] = 5000
        s = token_file.Segment(token_file.pack_segment([None, *range(39)], ends, ids))
        at = r.integers(0, 5000, 300)
        assert (s.get(at) == ids[at]).all()
        for a, b in r.integers(0, 5001, (50, 2)):
            assert (s.run(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()
        assert [x.tolist() for _, x in s.documents()] == [x.tolist() for x in np.split(ids, ends[:-1])]
        assert s.doc_ids[:2] == [None, 0]
    with pytest.raises(IndexError):
        s.get([5000])
    with pytest.raises(ValueError, match="segment"):
        token_file.Segment(b"x" * 100)


def test_op1_token_file(spark, docs, empty, tmp_path):
    ids_of = reference(WORD)
    token_file.write_tokens(docs, f"file://{tmp_path}/t", WORD, "word", 2, partitions=3, segment_ids=500)
    got = token_file.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    want = Counter((d, len(i := [*ids_of(t), 2]), crc(i)) for d, t, *_ in corpus())
    assert Counter((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got) == want
    at = 0
    for g in got:
        assert g["start"] == at
        at += g["n_tokens"]
    keys = [-1 if g["doc_id"] is None else g["doc_id"] for g in got]
    assert keys == sorted(keys)
    assert token_file.token_file(empty, WORD).count() == 0


def test_op2_quality(spark, docs, empty):
    def measures(text):
        text = text or ""
        words = [w for w in re.split(SPACES, text) if w]
        grams = defaultdict(list)
        for k in range(len(words) - 7):
            grams[tuple(words[k : k + 8])].append(k)
        covered = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(8)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)

    extra = [(10000 + k, t, "h9", "d", 1, "w", 2, 3, "W") for k, t in enumerate(["a b c d e f g h " * 9, "#1 $ %%\n#1 $ %%\n\n \n", "a " * 7, "w1 w2 w3 w4 w5 w6 w7 w8 x w1 w2 w3 w4 w5 w6 w7 w8 " + " ".join(map(str, range(40)))])]
    long = " ".join(f"v{k}" for k in range(30))
    extra += [(11000 + k, "short" if k else long, "bad", "d", 1, "w", 2, 3, "W") for k in range(80)] + [(12000 + k, long, f"fine{k % 3}", "d", 1, "w", 2, 3, "W") for k in range(240)]
    all_docs = docs.unionByName(spark.createDataFrame(extra, DOCS))
    got = quality.quality_report(all_docs).collect()
    rows = corpus() + extra
    want = Counter()
    for d, t, *_ in rows:
        m = measures(t)
        want[(d, *m, m[0] < 20 or 100 * m[4] > 30 * m[0])] += 1
    assert Counter((g["doc_id"], *(g[c] for c in quality.MEASURES), g["base_failed"]) for g in got) == want
    rates = defaultdict(lambda: [0, 0])
    for _, t, s, *_ in rows:
        m = measures(t)
        rates[s][0] += 1
        rates[s][1] += m[0] < 20 or 100 * m[4] > 30 * m[0]
    total, failed = (sum(x[k] for x in rates.values()) for k in (0, 1))
    mean = failed / total
    spread = sum(n * (f / n - mean) ** 2 for n, f in rates.values()) / total - mean * (1 - mean) * len(rates) / total
    weight = max(1, min(mean * (1 - mean) / spread - 1, 1e6)) if spread > 0 else 1e6
    bad = {s for s, (n, f) in rates.items() if (f + mean * weight) / (n + weight) > quality.HOST_RATE}
    assert bad and bad != set(rates)
    kept = Counter()
    for d, t, s, *_ in rows:
        m = measures(t)
        kept[(d, t)] += not (m[0] < 20 or 100 * m[4] > 30 * m[0]) and s not in bad
    good = quality.keep_good(all_docs)
    assert good.columns == all_docs.columns
    assert Counter((g["doc_id"], g["text"]) for g in good.collect()) == +kept
    assert sum(g["kept"] for g in got) == sum(kept.values())
    assert quality.quality_report(empty).count() == 0
    assert quality.keep_good(empty).count() == 0


def test_op2_hosts_fall_under_every_rule(spark):
    """Hosts of junk that passes the base rule go whole; a host with a tenth of it, and a small clean one, stay."""
    r = random.Random(4)

    def words(n, low=3, high=9):
        return ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(low, high))) for _ in range(n)]

    junk = {
        "symbols": lambda: " ".join(w + r.choice(["&&&", "%%%"]) for w in words(60)),
        "lines": lambda: "\n".join(x for x in (" ".join(words(3)) for _ in range(14)) for _ in range(1 + (r.random() < 0.9))),
        "lengths": lambda: " ".join(words(60, 18, 30)),
        "letters": lambda: " ".join(words(60, 1, 2)),
    }
    rows = [(f"bad {name}", f() if k % 10 else " ".join(words(50))) for name, f in junk.items() for k in range(60)]
    rows += [(f"mixed {name}", " ".join(words(50)) if k % 10 else f()) for name, f in junk.items() for k in range(60)]
    rows += [(f"clean {k % 8}", " ".join(words(50))) for k in range(400)] + [("few", " ".join(words(50))), (None, " ".join(words(50)))]
    docs = spark.createDataFrame([(k, t, s) for k, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    report = quality.quality_report(docs).collect()
    assert not any(g["base_failed"] for g in report)
    want = {k for k, (s, _) in enumerate(rows) if not (s or "").startswith("bad")}
    assert {g["doc_id"] for g in report if g["kept"]} == want
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {g["doc_id"] for g in good.collect()} == want


def test_op2_prior_shrinks(spark):
    hosts = spark.createDataFrame([("a", 1, 1), ("b", 1000, 900), ("c", 1000, 100), ("d", 500, 60)], "host string, n_rows long, n_failed long")
    alpha, beta = quality.beta_prior(hosts)
    small = (1 + alpha) / (1 + alpha + beta)
    assert alpha / (alpha + beta) < small < 1
    assert abs((900 + alpha) / (1000 + alpha + beta) - 0.9) < 0.02


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(SPACES, low) if w]


def set_of(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_shingles_are_those_of_the_words(monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 64)
    texts = [t or "" for _, t, *_ in corpus() if not t or len(t) < 5000]
    got = [frozenset(s.tolist()) for s in shingles.text_shingles(texts)]
    names = {}
    for t, g in zip(texts, got, strict=True):
        s = set_of(t)
        assert len(s) == len(g)
        assert names.setdefault(g, s) == s
    assert len({*names}) == len({*names.values()})


def test_op3_license_scan(spark, empty):
    r = random.Random(2)
    templates = license_scan.TEMPLATES
    rows = []
    for k in range(300):
        text = prose(r, r.randint(0, 80))
        for name in r.sample(list(templates), r.randint(0, 2)):
            words = templates[name].split()
            if r.random() < 0.3 and len(words) > 20:
                words[r.randrange(len(words))] = "changed"
            text += " " + r.choice(["", "\n", prose(r, 3) + " "]) + " ".join(words).upper() + " " + prose(r, r.randint(0, 30))
        rows.append((k, text))
    rows += [(1000, None), (1001, ""), (None, templates["GPL-3.0"]), (1002, templates["MIT-text"] + " " + templates["MIT-text"])]
    want = Counter()
    for d, t in rows:
        for name, template in templates.items():
            s, mine = set_of(template), set_of(t)
            if 100 * len(s & mine) >= 75 * len(s):
                want[(d, name, len(s & mine), len(s))] += 1
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((g["doc_id"], g["license"], g["n_shared"], g["n_template"]) for g in got) == want
    assert all(g["first_word"] < g["last_word"] for g in got)
    assert license_scan.license_scan(empty).count() == 0


def test_op3_wordings_of_licenses():
    """Wordings that are not taken from the templates; what is missed or mistaken in each."""
    disclaimer = "THIS SOFTWARE IS PROVIDED BY THE AUTHORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    two = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    third = "* Neither the name of Some Firm nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    gnu = "it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    cases = [
        ("Released under the MIT License, see LICENSE", {"MIT"}, set()),
        ("it is (licensed under the Apache License, Version 2.0 (see NOTICE)", {"Apache-2.0"}, set()),
        ("This tool is under the \u201cMIT License\u201d.", {"MIT-named"}, set()),
        ("License: BSD 3-Clause License", {"BSD-3-Clause-named"}, {"BSD-2-Clause-named"}),
        ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT\nint x;", {"GPL-2.0-only-SPDX", "MIT-SPDX"}, {"GPL-2.0-named"}),
        (two + disclaimer, {"BSD-2-Clause-full"}, {"BSD-3-Clause-full", "BSD-4-Clause-full"}),
        (two + third + disclaimer, {"BSD-3-Clause-full"}, {"BSD-2-Clause-full", "BSD-4-Clause-full"}),
        (two + disclaimer + " x " + two + third + disclaimer, {"BSD-2-Clause-full", "BSD-3-Clause-full"}, {"BSD-4-Clause-full"}),
        ("# This program is free software; you can redistribute it and/or modify\n# " + gnu.format("General", "2"), {"GPL-2.0-notice"}, {"GPL-3.0-notice", "LGPL-2.1-notice"}),
        ("Foo is free software: you can redistribute it and/or modify " + gnu.format("Affero General", "3"), {"AGPL-3.0-notice"}, {"GPL-3.0-notice", "GPL-2.0-notice", "LGPL-3.0-notice"}),
        ("Foo is free software; you can redistribute it and/or modify " + gnu.format("Lesser General", "2.1"), {"LGPL-2.1-notice"}, {"GPL-2.0-notice", "LGPL-3.0-notice", "LGPL-2.0-notice"}),
        (
            "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED 'AS IS' AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
            {"ISC-full"}, {"0BSD-full"},
        ),
        ("Text licensed under a Creative Commons Attribution-ShareAlike 4.0 International License; this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License!", {"CC-BY-SA-4.0-notice"}, {"CC-BY-4.0-notice"}),
        ("A permit of the town, and the mit of a license is under review by the board of the gnu reserve.", set(), None),
    ]
    scanner = license_scan._default()
    for text, want, unwanted in cases:
        got = {x[1] for x in scanner.scan(["other text", "so begins " + text])}
        assert want <= got and not got & unwanted if unwanted is not None else not got, (text[:80], got)
    for name, text in license_scan.whole_texts().items():
        assert name in {x[1] for x in scanner.scan([prose(random.Random(1), 30) + " " + text])}
    agpl = {x[1] for x in scanner.scan([license_scan.whole_texts()["AGPL-3.0-full"]])}
    assert "AGPL-3.0-full" in agpl and "GPL-3.0-full" not in agpl


def test_op4_exact_dedup(spark, docs, empty, tmp_path):
    def norm(t):
        return re.sub(SPACES, " ", t or "")

    rows = corpus()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append(d)
    want, kept = Counter(), Counter()
    for d, t, *_ in rows:
        ids = groups[norm(t)]
        keep = min((i for i in ids if i is not None), default=None)
        want[(d, keep, len(ids), hashlib.sha256(norm(t).encode()).hexdigest())] += 1
        kept[norm(t)] = 1
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"]) for g in got) == want
    assert Counter(g["text_sha256"] for g in got if g["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in kept)
    assert all(g["doc_id"] == g["keep_id"] for g in got if g["kept"])
    rest = exact_dedup.keep_first(docs)
    assert rest.columns == docs.columns
    assert Counter(norm(g["text"]) for g in rest.collect()) == kept
    assert exact_dedup.exact_dedup(empty).count() == 0
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    first = docs.where("doc_id < 60")
    a = exact_dedup.exact_dedup(first, index).where("kept").count()
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    assert again.read().count() == a
    assert exact_dedup.exact_dedup(first, again).where("kept").count() == a  # a batch may be repeated
    later = {g["text_sha256"]: g["keep_id"] for g in exact_dedup.exact_dedup(docs, again).collect()}
    assert again.read().count() == len(kept)
    assert all(later[hashlib.sha256(norm(t).encode()).hexdigest()] == min(i for i in groups[norm(t)] if i is not None and i < 60) for d, t, *_ in rows if d is not None and d < 60)
    plan = index.absent(spark.createDataFrame([(b"x", 1)], "digest binary, keep_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_hot_keys_join_whole(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 11 = 0, null, concat('k', id % 1700))) k")
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.max("id").alias("top"))
    got = common.join_by_key(rows, groups, "k", 5000, "id")
    assert got.count() == 5000
    assert got.where("k IS NOT NULL AND top IS NULL OR k IS NULL AND top IS NOT NULL").count() == 0
    assert got.where("k = 'hot'").select("n_rows").distinct().collect()[0][0] == 1667


def test_op5_pieces(spark, docs, empty, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(encode, "CACHE_CHARS", 5000)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = Counter((d, tuple(sp.encode(t or ""))) for d, t, *_ in corpus())
    encoded = pieces.encode_pieces(docs, PIECE)
    assert Counter((g["doc_id"], tuple(g["ids"])) for g in encoded.collect()) == want
    back = pieces.decode_pieces(encoded, PIECE)
    assert Counter((g["doc_id"], g["text"]) for g in back.collect()) == Counter((d, t or "") for d, t, *_ in corpus())
    report = pieces.encode_report(docs, PIECE).collect()
    assert all(g["round_trip"] for g in report)
    assert Counter((g["doc_id"], g["n_ids"], g["ids_crc32"]) for g in report) == Counter((d, len(i), crc(i)) for (d, i), n in want.items() for _ in range(n))
    assert pieces.encode_report(empty, PIECE).count() == 0


def test_op5_unigram_is_the_best_sum():
    r = random.Random(4)
    names = sorted({"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))) for _ in range(40)} | {"a", "b", "▁"})
    names = [n for n in names if "▁" not in n.lstrip("▁")]
    model = pieces.PieceModel([("<unk>", 0.0, 2), *((n, -r.random() * len(n) - 0.1, 1) for n in names)], pieces.UNIGRAM)
    score = {n: s for n, s, t in model.pieces if t == 1}

    def best(text):
        top = [0.0] + [-1e9] * len(text)
        for i in range(1, len(text) + 1):
            for j in range(i):
                if text[j:i] in score:
                    top[i] = max(top[i], top[j] + score[text[j:i]])
        return top[-1]

    for _ in range(300):
        text = "▁" + "".join(r.choice("ab") for _ in range(r.randint(0, 9)))
        got = [model.pieces[k][0] for k in model.segment(text)]
        assert "".join(got) == text
        assert abs(sum(score[p] for p in got) - best(text)) < 1e-9
    assert model.segment("▁acb")[-2:-1] == [0]


def test_op6_token_counts(spark, docs, empty):
    ids_of = reference(BYTE)
    states = token_counts.count_states(docs, BYTE, public_tokenizers.PATTERN)
    out = token_counts.apply_edits(token_counts.middle_edits(states), BYTE, public_tokenizers.PATTERN).collect()
    assert len(out) == len(corpus())
    for g in out:
        assert g["n_tokens"] == len(ids_of(g["text"]))
    assert Counter(g["n_tokens_before"] for g in out) == Counter(len(ids_of(t)) for _, t, *_ in corpus())
    longest = max(out, key=lambda g: len(g["text"]))
    assert longest["n_encoded"] < 200 < longest["n_tokens"]
    assert token_counts.count_states(empty, BYTE, public_tokenizers.PATTERN).count() == 0


def test_op6_edits_anywhere():
    ids_of, c = reference(BYTE), token_counts.Counter(BYTE, public_tokenizers.PATTERN)
    r = random.Random(3)
    bits = [" ", "  ", "\n", "'s", "a", "é", " \n x", "\x1c", "12", "...", "", "日本"]
    for text in ["", "a", " ", "  \n ", prose(r, 400), prose(r, 60)]:
        t = token_counts.CountTree.of(c, text)
        for _ in range(40):
            a = r.randrange(len(t.text) + 2)
            b = a + r.choice([0, 0, 1, 3, 30])
            new = "".join(r.choice(bits) for _ in range(r.randrange(5)))
            want = t.text[:a] + new + t.text[max(a, b) :]
            t.edit(a, b, new)
            assert t.text == want
            assert t.n_tokens == len(ids_of(want))
            assert t.n_chars == len(want)


def test_op7_sharding(spark, docs, empty, tmp_path):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = spark.range(2000).select(F.col("id"), F.xxhash64("id").alias("k"))
    for n in (1, 2, 16, 40):
        a, b = sharding.jump_hash(F.col("k"), n)
        for row in keys.select("k", a.alias("a"), b.alias("b")).collect():
            assert (row["a"], row["b"]) == (jump(row["k"] % 2**64, n), jump(row["k"] % 2**64, n + 1))
    got = sharding.shard(docs, 4).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in corpus())
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == want
    slots = defaultdict(list)
    for g in got:
        slots[g["shard"]].append(g["slot"])
        assert g["law"] == "key" and g["grown_shard"] in (g["shard"], 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == {0, 1, 2, 3}
    assert len({g["shard"] for g in got if g["doc_id"] == 3}) == 1
    sharding.write_shards(docs.select("doc_id", "text"), f"file://{tmp_path}/s", 4)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == len(got)
    assert sharding.shard(empty).count() == 0


def check_packing(got, want, size):
    """Each id is in one piece, and sequences hold their pieces without a gap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for g in got:
        ids = np.frombuffer(g["ids"], "<u4")
        assert len(ids) == g["length"] > 0
        by_doc[g["doc_id"], g["doc_tokens"]].append((g["start"], ids.tolist()))
        by_sequence[g["sequence_id"]].append((g["offset"], g["length"]))
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    found = Counter()
    for key, parts in by_doc.items():
        copies = sum(1 for start, _ in parts if start == 0)
        joined = [i for start, ids in sorted(parts) for i in ids]
        found[key] = copies, Counter(joined)
    expected = {}
    for d, ids in want:
        copies, held = expected.get((d, len(ids)), (0, Counter()))
        expected[d, len(ids)] = copies + 1, held + Counter(ids)
    assert found == expected
    return by_sequence


def test_op8_packing(spark, docs, empty):
    ids_of = reference(BYTE)
    got = packing.pack(docs, BYTE, size=128, open_windows=8).collect()
    want = [(d, [*ids_of(t), 0]) for d, t, *_ in corpus()]
    sequences = check_packing(got, want, 128)
    tokens = sum(len(i) for _, i in want)
    assert len(sequences) * 128 - tokens < 0.03 * tokens + 128
    assert packing.pack(empty, BYTE).count() == 0


def test_op8_windows_fit_best():
    w = packing.Windows(10, 2)
    assert w.place("a", 6) is None and w.place("b", 7) is None
    assert w.place("c", 3) == ["b", "c"]
    assert w.place("d", 5) is None
    assert w.place("e", 8) == ["a"]
    assert sorted(w.rest()) == [["d"], ["e"]]


def components(rows):
    """Brute force: doc_id -> smallest doc_id that it is linked with."""
    nodes = [(d, set_of(t)) for d, t in rows if d is not None]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(nodes):
        for b, u in nodes[:i]:
            both = len(s & u)
            if both and 100 * both >= 75 * (len(s) + len(u) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d, _ in nodes}


@pytest.mark.parametrize("block", [1024, 8])
def test_op9_near_dedup(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 10 if block == 8 else 10**6)
    rows = [(d, t) for d, t, *_ in corpus() if not (d == 5 and t and t.startswith("another"))]
    part = docs.where("NOT (doc_id = 5 AND text LIKE 'another%') OR doc_id IS NULL OR text IS NULL")
    want = components(rows)
    got = near_dedup.near_dedup(part).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g["component_id"] == (want[g["doc_id"]] if g["doc_id"] is not None else None)
        assert g["kept"] == (g["doc_id"] is None or g["doc_id"] == g["component_id"])
    assert Counter((g["doc_id"], g["n_shingles"]) for g in got) == Counter((d, len(set_of(t))) for d, t in rows)
    rest = near_dedup.keep_representatives(part)
    assert rest.columns == part.columns
    assert Counter(g["doc_id"] for g in rest.where("doc_id IS NOT NULL").collect()) == Counter({d for d, c in want.items() if d == c})
    assert near_dedup.near_dedup(empty).count() == 0


def test_op9_group_without_a_centre(spark):
    """Texts in a chain, of which only neighbours are similar, and many copies that differ among themselves."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 60])) for k in range(7)]
    base = [f"b{k}" for k in range(80)]
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(80)] = f"x{r.randrange(1000)}"
        rows.append((1000 + k, " ".join(w)))
    want = components(rows)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g["doc_id"]: g["component_id"] for g in got} == want


def test_op9_pigeonhole():
    """Signatures that differ in no more than 27 places have a key in common."""
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 16, (500, near_dedup.HASHES)).astype(np.uint16)
    b = a.copy()
    for k in range(len(b)):
        b[k, r.choice(near_dedup.CHUNKS * near_dedup.SYMBOLS, 27, replace=False)] ^= 1
    ka, kb = near_dedup.index_keys(a), near_dedup.index_keys(b)
    assert all((x == y).any() for x, y in zip(ka, kb, strict=True))
    first = near_dedup._canonical(a, b)
    assert all((x == y)[f] and not (x == y)[:f].any() for x, y, f in zip(ka, kb, first, strict=True))


def test_op10_blocks():
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href=x>One</a> <a>Two</a></nav><!-- <p>no</p> -->"
        "<article><h1>A&amp;B</h1><p>one<br>two <b>three<p>four\n\t five<ul><li>x<li>y</ul><div>z<span>z</span></div></article><textarea><p>raw</textarea><p title='a>b'>end"
    )
    got = html_blocks.blocks(page)
    assert [b.text for b in got] == ["One Two", "A&B", "one two three", "four five", "x", "y", "zz", "<p>raw", "end"]
    assert got[0].linked == 6 and got[0].above == ("html", "body", "nav")
    assert got[5].above[-3:] == ("article", "ul", "li")
    assert html_blocks.blocks("") == html_blocks.blocks("<") [:0] == []


def test_op10_blocks_without_optional_tags():
    def texts(page):
        return [b.text for b in html_blocks.blocks(page)]

    for start in ("<html><head><title>T</title><meta charset=x><body>", "<head><title>T</title>", "<head><script>x</script><noscript><link href=x></noscript>", "<head><noscript><meta name=y>", "<title>T</title><style>p{}</style>"):
        assert texts(start + "<p>one<p>two") == ["one", "two"], start
        assert texts(start + "<a href=x>one</a> two") == ["one two"], start
        assert texts(start + " one <div>two</div>") == ["one", "two"], start
    assert texts("<head><template><p>no</template><title>T</title></head><p>one") == ["one"]
    assert texts("<body><div><svg><path d=x><text>no<p>one</div><p>two") == ["one", "two"]
    assert texts("<body><svg><foreignObject><p>no</p></foreignObject><text>no</text></svg><p>one") == ["one"]
    assert texts("<body><object data=x><p>one</p><p>two") == ["one", "two"]
    assert texts("<body><noscript><p>one</p><p>two<noscript><p>no</p></noscript><p>three") == ["one", "two", "three"]
    assert texts("<body><object><p>no</p></object><noscript>no</noscript><p>one") == ["one"]
    formula = "<math><semantics><mrow><mi>a</mi><mo>+</mo><mn>1</mn></mrow><annotation encoding=tex>\\no</annotation></semantics></math>"
    assert texts(f"<article><p>so {formula} holds.</p></article>") == ["so a+1 holds."]


def test_op10_main_text_without_head_end():
    model = html_extract.trained()
    some = 0
    for seed in range(2 * 10**6, 2 * 10**6 + 30):
        page, _ = html_pages.labelled_page(seed)
        bare = page.replace("</head>", "").replace("</body>", "").replace("</html>", "")
        assert bare != page and model.main_text(bare) == model.main_text(page)
        some += bool(model.main_text(bare))
    assert some == 30


def test_op10_held_out_pages():
    model = html_extract.trained()
    blocks = wrong = 0
    for seed in range(10**6, 10**6 + 150):
        page, labels = html_pages.labelled_page(seed)
        got = model.decode(html_blocks.blocks(page))
        assert len(got) == len(labels)
        blocks += len(got)
        wrong += sum(a != b for a, (_, b) in zip(got, labels, strict=True))
    assert wrong < 0.01 * blocks


def test_op10_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(2)
    s, moves = r.normal(size=(5, 2)), r.normal(size=(2, 2))

    def log_sum(s):
        out = []
        for k in range(32):
            y = [(k >> i) & 1 for i in range(5)]
            out.append(sum(s[i, y[i]] for i in range(5)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        return np.logaddexp.reduce(out)

    each, _ = html_extract._expected(s, moves)
    for i in range(5):
        up = s.copy()
        up[i, 1] += 1e-6
        assert abs((log_sum(up) - log_sum(s)) / 1e-6 - each[i, 1]) < 1e-4


def test_op10_extract(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = '<body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title here</h1><p>Some prose of the article, long enough to be one.</p></article><section class="comments"><p>I disagree with all of it, said a reader at some length.</p></section><footer>&copy; x</footer></body>'
    rows = [(1, "u", page, "clash", "c"), (2, None, None, None, None), (None, "v", "", None, None), (1, "u", page, "clash", "c")]
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert Counter((g["page_id"], g["text"]) for g in got) == Counter({(1, "Title here\nSome prose of the article, long enough to be one."): 2, (2, ""): 1, (None, ""): 1})
    assert all(g["n_chars"] == len(g["text"]) for g in got)
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    rows = [(k, prose(r, r.randint(5, 80)), "lang", f"h{k % 3}", 0) for k in range(150)]
    rows += [(200 + k, rows[k][1].replace(" ", "  "), "lang", "h0", 0) for k in range(20)]
    rows += [(300 + k, rows[60 + k][1] + " more", "lang", "h1", 0) for k in range(20)]
    rows += [(400, "same words here again and more " * 20, "lang", "h2", 0), (401, None, "lang", "h2", 0), (402, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    good = []
    for d, t, *_ in rows:
        w = [x for x in re.split(SPACES, t or "") if x]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w):
            good.append((d, t))
    first = {}
    for d, t in sorted(good):
        first.setdefault(re.sub(SPACES, " ", t), (d, t))
    component = components(list(first.values()))
    kept = [(d, t) for d, t in first.values() if component[d] == d]
    ids_of = reference(BYTE)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(got, [(d, [*ids_of(t), 0]) for d, t in kept], 1024)
    assert len(kept) < len(first) < len(good) < len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "packing"]


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_exact_dedup", "op7_sharding", "op9_minhash_near_dedup"])
def test_sql_gives_the_same_rows(spark, name, tmp_path):
    """Not on sf data alone: texts of up to three bytes, of one code point in four bytes, and over a block long."""
    import duckdb

    from sparrel.llm import queries as q

    texts = ["", "a", "ab", "abc", "abcd", "\U0001f600 é", None, "word " * 25, "x" * 127, "x" * 128, "x" * 129, " ".join(map(str, range(900)))]
    texts += [" ".join(map(str, range(899))), " ".join(map(str, range(700))), "A b\tC d E", "a B c D e"]
    rows = [(k * 37, t, "en", f"host{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = q.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, want.select(*sorted(want.columns)).fetchall()))
