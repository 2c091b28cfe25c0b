"""Whole queries, and the stages of the pipeline, against plain-Python versions at sf0.001."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tissuelake.llm import common, fingerprints, language_id, mixing, packing, quality_classifier, quality_rules, queries, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().astype(object).where(lambda d: d.notna(), None)


def words(text):
    return WORD.findall(text or "")


def plain_sketch(text):
    w, n = words(text), fingerprints.SHINGLE_WORDS
    of = lambda value, seed: xxhash.xxh64_intdigest(value, seed)

    def shingle(i):
        h = of(w[i].encode(), 42)
        for j in range(1, n):
            h = of(w[i + j].encode(), of(struct.pack("<Q", h), 42))
        return h

    hashes = [shingle(i) for i in range(len(w) - n + 1)] if len(w) >= n else [of(" ".join(w).encode(), 42)] if w else []
    return sorted({h >> 33 for h in hashes})[: fingerprints.K]


def plain_resemblance(a, b):
    union = sorted(set(a) | set(b))
    if max(len(a), len(b)) >= fingerprints.K:
        union = union[: fingerprints.K]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def test_op10_whole_query(spark, documents):
    rows = sorted(((d, t or "") for d, t in zip(documents.doc_id, documents.text, strict=True)), reverse=True)
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    as_text = lambda s: base64.b64encode(b"".join(struct.pack(">I", h) for h in s)).decode()
    for (doc_id, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, following, r = plain_sketch(text), plain_sketch(edited), plain_sketch(after), got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(own), as_text(other))
        assert math.isclose(r.near_edited, plain_resemblance(own, other)) and math.isclose(r.near_next, plain_resemblance(own, following))


def test_op5_whole_query(spark, documents):
    pieces = token_counts.vocabulary(token_counts.tokenizer_path())
    unknown, longest, known = min(pieces.values()) - 10, max(map(len, pieces)), {}

    def tokens(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + unknown * n, best[end - 1][1] - n)]
            options += [(best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in pieces]
            best.append(max(options))
        return -best[-1][1]

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op5_token_counts(spark, SF).collect()}
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        for w in words(text):
            if w not in known:
                known[w] = tokens("▁" + w)
        assert got.pop(doc_id) == (len(words(text)), sum(known[w] for w in words(text)))
    assert not got


def check_packed(pieces, texts):
    """texts: {doc_id: text}, each doc_id once."""
    from tokenizers import Tokenizer

    whole, at, of = Tokenizer.from_file(packing.tokenizer_path()), Counter(), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
    assert set(of) == set(texts)
    total = 0
    for doc_id, text in texts.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(of[doc_id], key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own))) and len(own) == math.ceil(len(ids) / packing.CAPACITY)
        assert all(p.length == packing.CAPACITY for p in own[1:]) and sum(p.length for p in own) == len(ids)
        for i, p in enumerate(own):
            assert p.start == sum(q.length for q in own[:i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at[p.sequence_id]
        at[p.sequence_id] += p.length
    assert max(at.values()) <= packing.CAPACITY and len(at) <= 1.02 * total / packing.CAPACITY + 1


def test_op7_whole_query(spark, documents):
    check_packed(queries.op7_packing(spark, SF).collect(), dict(zip(documents.doc_id, documents.text, strict=True)))


def sainte_lague(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats if sum(votes.values()) > 0 else 0):
        best = min(votes, key=lambda k: (-votes[k] / (2 * got[k] + 1), k is not None, k or 0 if not isinstance(k, str) else k))
        got[best] += 1
    return got


def plain_mix(rows, shard_words):
    """{doc_id: words taken} of (doc_id, source, text) rows with doc_ids that differ."""
    size = {d: len(words(t)) for d, _, t in rows}
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    whole = {s: sum(size[d] for d, x, _ in rows if x == s) for s in sources}
    target, free, left = {}, set(sources), float(sum(whole.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * whole[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * whole[s]
            left -= target[s]
            free.discard(s)
    block = max(1, min([mixing.BLOCK, *(n // 16 for n in whole.values() if n)]))
    quota, taken = sainte_lague(target, int(sum(whole.values()) / block + 0.5)), {}
    for s in sources:
        shards, n = defaultdict(list), max(1, math.ceil(whole[s] / shard_words))
        for d in sorted((hashlib.md5(f"0:{d}".encode()).hexdigest(), d) for d, x, _ in rows if x == s):
            shards[int(d[0][:12], 16) % n].append(d[1])
        length = {k: sum(size[d] for d in ds) for k, ds in shards.items()}
        blocks_of = sainte_lague({k: float(v) for k, v in length.items()}, quota[s])
        for k, ds in shards.items():
            blocks = max(1, int(length[k] / block + 0.5))
            repeats, rest = divmod(min(blocks_of[k], 3 * blocks), blocks)
            cut, at = int(rest * length[k] / blocks), 0
            for d in ds:
                taken[d] = repeats * size[d] + max(0, min(size[d], cut - at))
                at += size[d]
    return target, taken


@pytest.mark.parametrize("shard_words", [mixing.SHARD, 1500])
def test_op8_whole_query(spark, documents, monkeypatch, shard_words):
    monkeypatch.setattr(mixing, "SHARD", shard_words)
    target, taken = plain_mix(list(documents[["doc_id", "source", "text"]].itertuples(index=False)), shard_words)
    source = dict(zip(documents.doc_id, documents.source, strict=True))
    got = queries.op8_mixing(spark, SF).collect()
    assert {r.doc_id: r.taken for r in got} == taken
    assert all(math.isclose(r.target, target[source[r.doc_id]], rel_tol=1e-9) for r in got)


def test_small_sources_near_their_targets(spark):
    """op8_mixing: a source of 30 words and one of a single word are taken three times, beside a large one."""
    rows = [(i, "c", " ".join(f"w{j}" for j in range(50))) for i in range(20)] + [(100, "a", " ".join(f"a{j}" for j in range(30))), (101, "b", "b"), (102, "b", None), (103, None, "")]
    target, taken = plain_mix(rows, mixing.SHARD)
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r.doc_id: r.taken for r in got} == taken
    assert (taken[100], taken[101]) == (90, 3) == (target["a"], target["b"])
    assert all(r.taken <= 3 * r.size for r in got)


def plain_hash(word):
    """A word's hash, from its bytes one by one."""
    total = sum(int(common._BYTE[b]) * pow(common._BASE, i, 2**64) for i, b in enumerate(word))
    return plain_mix64(total + len(word) * 0x9E3779B97F4A7C15)


def plain_mix64(x):
    x %= 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def plain_shape(word):
    """The hash of a word's character classes, runs counted once; the first character's place is 0."""
    classes = [int(quality_classifier._CLASS[b]) for b in word]
    runs = [c for i, c in enumerate(classes) if not i or c != classes[i - 1]]
    return plain_mix64(sum(plain_mix64(int(quality_classifier._SHAPE[c]) * (2 * i + 1)) for i, c in enumerate(runs)))


def plain_vector(text):
    w = [plain_hash(re.sub("[A-Z]", lambda m: m[0].lower(), x).encode()) for x in words(text)]
    s = [plain_shape(x.encode()) for x in words(text)]
    s = [int(quality_classifier._SAME) if i and w[i] == w[i - 1] else h for i, h in enumerate(s)]
    grams = [h + 1 for h in w] + [3 * a + b for a, b in zip(w, w[1:])] + [h + 2 for h in s] + [5 * a + b for a, b in zip(s, s[1:])]
    counts = Counter(1 + plain_mix64(g) % (quality_classifier.BUCKETS - 1) for g in grams)
    return {0: 1.0} | {p: math.sqrt(c / (4 * len(w))) for p, c in counts.items()}


def plain_ftrl(rows):
    """Follow-the-regularised-leader on dictionaries."""
    c, z, n = quality_classifier, defaultdict(float), defaultdict(float)
    weight = lambda p: 0.0 if abs(z[p]) <= c.L1 else -(z[p] - math.copysign(c.L1, z[p])) / ((c.BETA + math.sqrt(n[p])) / c.ALPHA + c.L2)
    for _ in range(c.PASSES):
        for vector, label in rows:
            w = {p: weight(p) for p in vector}
            error = 1 / (1 + math.exp(-sum(w[p] * v for p, v in vector.items()))) - label
            for p, v in vector.items():
                g = error * v
                z[p] += g - (math.sqrt(n[p] + g * g) - math.sqrt(n[p])) / c.ALPHA * w[p]
                n[p] += g * g
    return {p: weight(p) for p in z}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_op1_whole_query(spark, documents):
    """Features, updates and scores from plain dictionaries; only the order of the fit's rows is Spark's hash of doc_id."""
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [d for d in documents.doc_id if d in quality and not held_out(d)]
    assert len(ids) < quality_classifier.FIT_ROWS  # so that all of them are in the fit
    place = {r.d: r.h for r in spark.createDataFrame([(int(d),) for d in ids], "d long").selectExpr("d", "xxhash64(d) as h").collect()}
    vectors = {d: plain_vector(t) for d, t in zip(documents.doc_id, documents.text, strict=True)}
    weights = plain_ftrl([(vectors[d], quality[d]) for d in sorted(ids, key=lambda d: (place[d], d))])
    got = {r.doc_id: r for r in queries.op1_quality_classifier(spark, SF).collect()}
    assert set(got) == set(vectors)
    for d, vector in vectors.items():
        score = 1 / (1 + math.exp(-sum(weights.get(p, 0.0) * v for p, v in vector.items())))
        assert math.isclose(got[d].score, score, rel_tol=1e-7) and got[d].held_out == held_out(d) and got[d].predicted == int(got[d].score >= 0.5)


def plain_grams(text):
    """n-grams of runs of letters with their ends."""
    out = Counter()
    for word in (text or "").encode().split():
        lower = word.decode().lower()
        for run in "".join(c if c.isalpha() else " " for c in lower).split():
            padded = f"_{run}_"
            out.update(padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1))
    return out


def test_op3_whole_query(spark, documents):
    """Sets of n-grams for each language instead of filters: the same language unless two are close, the score but for false positives."""
    grams = {d: plain_grams(t) for d, t in zip(documents.doc_id, documents.text, strict=True)}
    seen = defaultdict(Counter)
    for d, lang, text in zip(documents.doc_id, documents.lang, documents.text, strict=True):
        if lang is not None and text is not None and not held_out(d):
            seen[lang].update(grams[d])
    total = {lang: sum(c.values()) for lang, c in seen.items()}
    best = defaultdict(float)
    for lang, c in seen.items():
        for g, n in c.items():
            if n >= language_id.LEAST:
                best[g] = max(best[g], n / total[lang])
    own = {lang: {g for g, n in c.items() if n >= language_id.LEAST and n / total[lang] >= language_id.KEEP * best[g]} for lang, c in seen.items()}
    got = {r.doc_id: r for r in queries.op3_language_id(spark, SF).collect()}
    assert set(got) == set(grams)
    for d, counted in grams.items():
        hits = {lang: sum(n for g, n in counted.items() if g in own[lang]) for lang in sorted(own)}
        if not counted:
            assert (got[d].lang_pred, got[d].score) == (language_id.UNKNOWN, 0.0)
            continue
        first, second, *_ = sorted(hits.values(), reverse=True)
        if first - second > 0.02 * sum(counted.values()):
            assert got[d].lang_pred == max(hits, key=hits.get)
            assert abs(got[d].score - first / sum(hits.values())) < 0.03
        assert got[d].held_out == held_out(d)


def test_texts_without_doc_id_meet_the_next(spark):
    """op10_fingerprints: many rows without doc_id, and one doc_id many times."""
    rows = [(None, f"none {i} " + "x" * i) for i in range(200)] + [(5, f"five {i} and more") for i in range(50)] + [(9, "nine " * 40), (7, None), (None, "none 3 xxx")]
    table = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, salt int")
    prints = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) as h").distinct().collect()}
    lead = {d: min((t or "" for x, t in rows if x == d), key=prints.get) for d in (None, 5, 7, 9)}
    after = {9: lead[7], 7: lead[5], 5: lead[None], None: lead[9]}
    edited = lambda d, t: t[: len(t) - len(t) // 3] + after[d][: len(t) // 3]
    got = fingerprints.with_edited(table).collect()
    assert Counter((r.doc_id, r.text, r.edited) for r in got) == Counter((d, t or "", edited(d, t or "")) for d, t in rows)
    assert all(r.next_sketch == plain_sketch(after[r.doc_id]) and r.sketch == plain_sketch(r.text) and r.edited_sketch == plain_sketch(r.edited) for r in got)


def near_kept(rows):
    grams = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) else None for d, t in rows}
    parent = {d: d for d in grams}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(d for d in grams if grams[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(grams[a] & grams[b])
            if 100 * both >= 80 * (len(grams[a]) + len(grams[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d for d in grams if root(d) == d}


def without_repeats(rows, window=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def test_pipeline_stage_by_stage(spark):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    pairs = lambda d: [(r.doc_id, r.text) for r in d.collect()]

    good = stages["quality rules"](spark, docs, SF).cache()
    entries = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    fails = lambda m: (
        m.n_words < 50
        or 100 * m.n_repeat_words > 50 * m.n_words
        or 100 * m.n_symbols > 10 * m.n_words
        or 100 * m.n_dup_lines > 50 * m.n_lines
        or not 2 * m.n_words <= m.word_chars <= 15 * m.n_words
        or 100 * m.n_upper > 50 * m.word_chars
    )
    assert sorted(pairs(good)) == sorted((d, t) for d, t in pairs(docs) if not fails(entries[d]))

    single = stages["near duplicates"](spark, good, SF).cache()
    kept = near_kept(pairs(good))
    assert sorted(pairs(single)) == sorted((d, t) for d, t in pairs(good) if d in kept) and len(kept) < good.count()

    cut = stages["repeated passages"](spark, single, SF).cache()
    assert {d: words(t) for d, t in pairs(cut)} == {d: w for d, w in without_repeats(pairs(single)).items() if w}

    mixed = stages["mixing"](spark, cut, SF).cache()
    _, taken = plain_mix([(r.doc_id, r.source, r.text) for r in cut.collect()], mixing.SHARD)
    found = Counter()
    for d, t in pairs(mixed):
        found[d] += len(words(t))
    assert dict(found) == {d: n for d, n in taken.items() if n}
    assert mixed.columns == cut.columns == single.columns == good.columns == docs.columns

    packed = stages["packing"](spark, cut, SF).collect()  # of the stage before mixing, whose doc_ids differ
    check_packed(packed, dict(pairs(cut)))


def test_more_languages_than_bits(spark):
    letters = [chr(0x4E00 + 8 * k + j) for k in range(70) for j in range(8)]
    text = lambda k, seed: " ".join("".join(letters[8 * k + (seed * i + j * j) % 8] for j in range(6)) for i in range(60))
    rows = [(k * 10 + s, text(k, s), f"l{k:02}") for k in range(70) for s in (1, 2, 3)]
    filters = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(filters.languages) == 70 and filters.masks.shape[0] == 2
    fresh = spark.createDataFrame([(k, text(k, 5)) for k in range(70)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(fresh, filters).collect()} == {k: f"l{k:02}" for k in range(70)}
