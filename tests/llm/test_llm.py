"""The text operators on awkward rows, against brute force, and against SQL at sf0.001."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tissuelake.llm import fingerprints, language_id, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, queries, substring_dedup, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string"
LONG = " ".join(f"w{i % 700}" for i in range(5000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a", None, 1.0, "x"),
    (2, "", None, None, 0, None, None),
    (3, LONG, "en", "a", 1, 1.0, "x"),
    (4, LONG, "en", "b", 1, 1.0, "x"),
    (5, "one", "fr", "b", 3, 1.0, "x"),
    (5, "one", "fr", "b", 3, 1.0, "x"),
    (None, f"alpha beta {PASSAGE} gamma", "de", "c", 3, 1.0, "x"),
    (7, f"start {PASSAGE}  end\nof text", "de", None, 3, 1.0, "x"),
    (8, " \t\n ", "de", "c", 3, 1.0, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (7, None)], "doc_id long, label int")
    return {
        "classifier": lambda d: quality_classifier.score(d, quality_classifier.fit(d, labels)),
        "language": lambda d: language_id.predict(d, language_id.fit(d)),
        "near": lambda d: near_dedup.near_duplicates(d),
        "tokens": lambda d: token_counts.count_tokens(d, {"▁": -1.0, "a": -2.0}),
        "rules": quality_rules.ledger,
        "packing": lambda d: packing.pack(d),
        "mixing": lambda d: mixing.plan(d),
        "repeats": lambda d: substring_dedup.remove_repeats(d),
        "fingerprints": lambda d: fingerprints.with_edited(d),
        "licenses": lambda d: license_scan.scan(d.withColumn("path", F.col("source"))),
        "mix": lambda d: mixing.mix(d.withColumns({c: F.lit(1) for c in ("_c", "id", "print", "words", "n_words", "row", "size")}), most=3),
    }


@pytest.mark.parametrize("name", ["classifier", "language", "near", "tokens", "rules", "packing", "mixing", "repeats", "fingerprints", "licenses", "mix"])
def test_awkward_and_empty_tables(spark, docs, none, name):
    run = operators(spark)[name]
    rows = run(docs).count()
    assert rows >= len(ROWS) if name == "packing" else rows > 0 if name == "mix" else rows == len(ROWS)
    assert run(none).count() == 0


@pytest.mark.parametrize("name", ["op4_near_dedup", "op6_quality_rules", "op9_substring_dedup"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    a, b = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).to_numpy().tolist()))
    assert rows(a) == rows(b)


def test_passages_go_and_separators_stay(docs):
    cut = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, keep=["source"]).collect()}
    assert cut[7].kept_text == "start end\nof text" and cut[7].n_removed == 60
    assert cut[4].kept_text == "" and cut[4].n_removed == 5000


def test_equal_windows_choose_equal_anchors():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    names = []
    for _ in range(2):
        hashes = np.concatenate([rng.integers(0, 2**63, 30, dtype=np.uint64), passage, rng.integers(0, 2**63, 30, dtype=np.uint64)])
        starts, anchor, name = substring_dedup.anchors(hashes, np.array([0, 100]), 20)
        inside = (starts >= 30) & (starts <= 50)
        names.append([int(name[a]) if a >= 0 else None for a in anchor[inside]])
    assert names[0] == names[1]


def test_tokens_equal_the_tokenizer(docs, spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    texts = [t or "" for _, t, *_ in ROWS] + ["a  b", "a\n b", " x ", "c's 12 é　 你好", "end <|endoftext|> z"]
    encode = packing.ChunkEncoder(packing.tokenizer_path()).encode
    for t in texts:
        assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    rows = packing.pack(docs).collect()
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.CAPACITY
    ids = encode("one") + bytes(4)
    assert all(r.ids_crc32 == zlib.crc32(ids) for r in rows if r.doc_id == 5)


def test_a_pre_token_is_encoded_once_whatever_follows_it():
    own = packing.ChunkEncoder(packing.tokenizer_path())

    class Counted:
        def __init__(self, model):
            self.model, self.seen = model, Counter()

        def tokenize(self, piece):
            self.seen[piece] += 1
            return self.model.tokenize(piece)

    own.model = counted = Counted(own.model)
    for text in ("a word, a word. (word) word's", "word; word: \nword\n\nword? é words", "word  word", "\tword"):
        assert own.encode(text) == own._whole(text)
    assert "Ġword" in counted.seen and set(counted.seen.values()) == {1}


def test_plan_places_every_piece():
    random.seed(3)
    for capacity in (7, 60, 2048):
        counts = Counter(random.randint(1, capacity) for _ in range(300))
        rows = packing.plan(dict(counts), capacity)
        fill = Counter()
        for size, n in counts.items():
            own = rows[rows[:, 0] == size]
            for rank in range(n):
                _, first, each, first_bin, _ = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                fill[first_bin + (rank - first) // each] += size
        assert max(fill.values()) <= capacity and len(fill) <= 1.1 * (sum(s * n for s, n in counts.items()) / capacity) + 2


def test_mix_nears_targets(spark):
    rows = queries.op8_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert (rows.taken <= 3 * rows["size"]).all()
    by = rows.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert ((by.taken - by.target).abs() <= 0.03 * by.target + 64).all()


def test_token_counts_equal_plain_viterbi(spark):
    pieces = {"▁": -1.0, "▁a": -1.5, "a": -2.0, "b": -2.0, "ab": -2.5, "bab": -3.0}
    counter = token_counts.Counter(pieces)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + counter.unknown * n, best[end - 1][1] - n)]
            options += [(best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in pieces]
            best.append(max(options))
        return -best[-1][1]

    random.seed(5)
    words = ["".join(random.choice("abé") for _ in range(random.randint(1, 9))) for _ in range(300)]
    counter.learn([w.encode() for w in set(words)])
    assert all(counter.known[w.encode()] == plain("▁" + w) for w in words)


def test_fingerprints_estimate_resemblance(spark):
    texts = [" ".join(f"t{i}" for i in range(a, a + 600)) for a in (0, 100, 1000)] + ["few words only here now", ""]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((x, y) for x in texts for y in texts)], "i int, a string, b string")
    f, g = fingerprints.sketch(pairs.a), fingerprints.sketch(pairs.b)
    got = {r.i: r.r for r in pairs.select("i", fingerprints.resemblance(f, g).alias("r")).collect()}
    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set()
    for i, (a, b) in enumerate((x, y) for x in texts for y in texts):
        x, y = grams(a), grams(b)
        assert abs(got[i] - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.2


def test_next_document_is_by_descending_id(spark):
    draw = random.Random(7)
    ids = list({draw.randrange(-(2**62), 2**62) >> draw.choice((0, 30, 55)) for _ in range(300)} | {-(2**63), 5})
    got = {r.id: r.next_id for r in fingerprints.next_descending(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    order = sorted(ids, reverse=True)
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


def licenses_by_brute_force(files, least=license_scan.LEAST):
    """path, license and score of each file, by dictionaries."""
    split = license_scan.terms_of
    vocabulary = {t for texts in license_scan.TEMPLATES.values() for text in texts for t in split(text)}
    df = Counter(t for _, text in files for t in set(split(text or "")) & vocabulary)
    idf = lambda t: math.log((1 + len(files)) / (1 + df[t])) + 0.1
    vector = lambda text: {t: (1 + math.log(c)) * idf(t) for t, c in Counter(split(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(text), *license_scan.marks(name, text)) for name, texts in license_scan.TEMPLATES.items() for text in texts]
    out = []
    for path, text in files:
        text, best = text or "", (None, None)
        for piece in {text, *re.split(r"\n[ \t\r]*\n", text), *re.findall(license_scan._COMMENTS.replace("\\z", "\\Z"), text), *text.split("\n")}:
            v = vector(piece)
            for name, t, must, must_not in templates:
                if not must <= set(v) or must_not & set(v):
                    continue
                s = sum(w * t.get(k, 0.0) for k, w in v.items()) / (norm(v) * norm(t)) if v else 0.0
                if s >= least:
                    best = max(best, (round(s, 9), name), key=lambda x: (x[0] or 0.0, x[1] or ""))
        out.append((path, best[1], best[0]))
    return out


def test_licenses_are_found_and_inherited(spark):
    mit, apache = license_scan.TEMPLATES["MIT"][1], "Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE\n\n1. Definitions ..."
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os\n"
    files = [("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit), ("a/b/x.py", "print(1)"), ("a/b/y.py", gpl + "print(os.name)\n" * 40), ("LICENSE", apache), ("c/z.py", None), (None, "text"), (None, mit), (None, "text")]
    files += [(f"d/{i}.txt", f"plain words number {i} about the weather") for i in range(20)]
    rows = license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()
    got = {r.path: (r.license, r.inherited_from) for r in rows if r.path}
    assert {p: got[p] for p in ("a/LICENSE", "a/b/x.py", "a/b/y.py", "LICENSE", "c/z.py", "d/3.txt")} == {
        "a/LICENSE": ("MIT", None), "a/b/x.py": ("MIT", "a"), "a/b/y.py": ("GPL-3.0-or-later", None), "LICENSE": ("Apache-2.0", None), "c/z.py": ("Apache-2.0", ""), "d/3.txt": ("Apache-2.0", "")
    }
    assert sorted(str(r.license) for r in rows if r.path is None) == ["MIT", "None", "None"]
    want = licenses_by_brute_force(files)
    assert Counter((r.path, r.license if r.inherited_from is None else None, r.score) for r in rows) == Counter(want)


def test_licenses_of_like_wording(spark):
    """op2_license_scan: versions, "or later", tags and short notices are told apart; a file whose nearest piece is not its whole text does not speak for others."""
    gnu = lambda work, name, version: f"""# This {work} is free software; you can redistribute it and/or
# modify it under the terms of the GNU {name} as published by the Free Software Foundation; {version}
#
# This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {name} for more details.
x = 1
"""  # noqa: E731
    gpl, lgpl, agpl = ("General Public License", "Lesser General Public License", "Affero General Public License")
    later = "either version {} of the License, or (at your option) any later version."
    want = {
        gnu("program", gpl, "version 2 of the License."): "GPL-2.0-only",
        gnu("program", gpl, later.format("2")): "GPL-2.0-or-later",
        gnu("program", gpl, later.format("3")): "GPL-3.0-or-later",
        gnu("library", lgpl, later.format("2.1")): "LGPL-2.1-or-later",
        gnu("library", lgpl, "version 2.1 of the License."): "LGPL-2.1-only",
        gnu("library", lgpl, later.format("3")): "LGPL-3.0-or-later",
        gnu("program", agpl, later.format("3")): "AGPL-3.0-or-later",
        "// SPDX-License-Identifier: Apache-2.0\nint x;": "Apache-2.0",
        "# SPDX-License-Identifier: GPL-2.0-only\nx = 1": "GPL-2.0-only",
        "# SPDX-License-Identifier: GPL-3.0-or-later\nx = 1": "GPL-3.0-or-later",
        "/* SPDX-License-Identifier: BSD-2-Clause */": "BSD-2-Clause",
        "# SPDX-License-Identifier: Zlib": None,
        "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\nint y;": "BSD-3-Clause",
        "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "the library opens later than the program": None,
    }
    files = [(f"d{i}/f.py", text) for i, text in enumerate(want)] + [(f"e/{i}", f"plain words number {i} about free weather and the terms of {i}") for i in range(20)]
    files += [("g/notes", "MIT License mit released\n\nReleased under the MIT License."), ("g/other", "nothing")]
    rows = license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()
    got = {r.path: r for r in rows}
    assert {t: got[f"d{i}/f.py"].license for i, t in enumerate(want)} == want
    assert got["g/notes"].license == "MIT" and got["g/other"].license is None
    assert Counter((r.path, r.license if r.inherited_from is None else None, r.score) for r in rows) == Counter(licenses_by_brute_force(files))


def test_op2_whole_query(spark):
    """op2_license_scan on all documents, by dictionaries; no file of `documents` speaks for a directory unless it is a license as a whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "text").collect()
    files = [("/".join(x for x in (r.source, r.lang, str(r.doc_id // 1000), str(r.doc_id)) if x is not None), r.text) for r in docs]
    want = Counter((int(path.split("/")[-1]), name, score) for path, name, score in licenses_by_brute_force(files))
    got = queries.op2_license_scan(spark, SF).collect()
    assert Counter((r.doc_id, r.license if r.inherited_from is None else None, r.score) for r in got) == want
    assert any(name for _, name, _ in want)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    scored = queries.op1_quality_classifier(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.95
    found = queries.op3_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95


def test_ablations_count_single_failures(docs):
    entries = quality_rules.ledger(docs)
    bits = [r.failures for r in entries.collect()]
    got = {r.rule: (r.failed, r.failed_alone) for r in quality_rules.ablations(entries, "v1").collect()}
    for i, rule in enumerate(quality_rules.RULES):
        assert got[rule] == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))


def test_pipeline_stages(spark, docs, none):
    for table in (docs, none):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF)
            if name != "packing":
                assert kept.columns == table.columns
        kept.count()
    first = [r.text for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()]
    assert first and all(len(t.split()) >= 50 for t in first)


def test_edited_text_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    order = sorted(docs, key=lambda r: -r.doc_id)
    want = {}
    for r, nxt in zip(order, [*order[1:], order[0]], strict=True):
        k = len(r.text) // 3
        want[r.doc_id] = hashlib.sha256((r.text[: len(r.text) - k] + nxt.text[:k]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in queries.op10_fingerprints(spark, SF).select("doc_id", "edited_sha256").collect()} == want


def test_fit_on_empty_partitions():
    from tissuelake.llm import quality_classifier

    assert list(quality_classifier._train(iter([]))) == []


def test_hub_with_many_copies(spark):
    """op4_near_dedup: copies that link to the hub but not to each other all get its group, as by brute force."""
    draw = random.Random(11)
    hub = [f"h{i}" for i in range(200)]
    texts = [hub]
    for c in range(1000):
        copy = list(hub)
        for k, at in enumerate(sorted(draw.sample(range(1, 199), 9))):
            copy[at] = f"c{c}x{k}"
        texts.append(copy)
    draw.shuffle(texts)
    sets = [{tuple(t[i : i + 2]) for i in range(len(t) - 1)} for t in texts]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if group[i] != group[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table, shingle_words=2, percent=80).collect()}
    assert got == dict(enumerate(group)) and len(set(group)) < 100


def test_keep_one_by_rows(spark):
    """pipeline (near duplicates): rows without doc_id and other texts of a doc_id stay unless their group keeps another row."""
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (None, text("c")), (None, text("a")), (None, text("d")), (None, text("d")), (2, text("b", 41)), (None, None), (3, " "), (3, " ")]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (None, None), (3, " "), (3, " ")]
    assert Counter(map(tuple, got)) == Counter(want)


def crowd_of_pages(n, pairs, body, own, common):
    """Texts with the same body and `own` words of their own; the first 2 * pairs of them share `common` of these by twos."""
    draw = random.Random(n)
    words = [f"b{i}" for i in range(body)]
    texts = []
    for i in range(n):
        tail = [f"u{i}x{k}" for k in range(own)]
        if i < 2 * pairs:
            tail[:common] = [f"p{i // 2}x{k}" for k in range(common)]
        texts.append(words + tail)
    draw.shuffle(texts)
    return texts


def groups_by_brute_force(texts, percent=80):
    """The smallest place that each text reaches by links of two-word shingle sets; shingles of one text alone only count for its size."""
    sets = [{tuple(t[i : i + 2]) for i in range(len(t) - 1)} for t in texts]
    often = {g: i for i, g in enumerate(g for g, c in Counter(g for s in sets for g in s).items() if c > 1)}
    has = np.zeros((len(sets), len(often)), dtype=np.float32)
    for i, s in enumerate(sets):
        has[i, [often[g] for g in s if g in often]] = 1
    common = has @ has.T
    size = np.array([len(s) for s in sets])
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common) - 1e-3
    np.fill_diagonal(linked, True)
    group = np.arange(len(sets))
    while True:
        least = np.where(linked, group[None, :], len(sets)).min(axis=1)
        if (least == group).all():
            return dict(enumerate(group.tolist()))
        group = least


@pytest.mark.parametrize(("n", "pairs", "common"), [(2000, 200, 9), (3000, 300, 7)])
def test_crowds_of_pages_from_one_template(spark, n, pairs, common):
    """op4_near_dedup: pairs nearer than their crowd (resemblance about 0.76) are all found."""
    texts = crowd_of_pages(n, pairs, 160, 25, common)
    want = groups_by_brute_force(texts)
    assert len(set(want.values())) == n - pairs
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table, shingle_words=2, percent=80).collect()}
    assert got == want


def test_stages_leave_columns_of_any_name_alone(spark):
    """pipeline: names that the operators use themselves, and names with a dot, keep their values."""
    names = ["_key", "_place", "n_words", "n_removed", "kept_text", "row", "a.b", "id", "print", "component_id"]
    prose = lambda seed: " ".join(f"word{random.Random(seed * 1000 + i).randrange(900)}" for i in range(120))
    rows = [(i, prose(i), "en", f"s{i % 2}", 5, *(f"{i}-{k}" for k in range(len(names)))) for i in range(6)]
    rows.append((6, rows[0][1], *rows[0][2:]))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.select(F.col("doc_id"), F.array(*(F.col(f"`{c}`") for c in names)).alias("v")).collect()
        assert got and all(tuple(r.v) == rows[r.doc_id][5:] for r in got), name
        if name == "near duplicates":
            assert sorted(r.doc_id for r in got) == list(range(6))
