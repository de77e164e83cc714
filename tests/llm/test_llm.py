"""The training-data operators on small tables: edge cases, brute force, round trips, held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows_of
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from valora.llm import _bins, _kernel as K, _spark as S, decontaminate, language_id, license_scan, lm_score, media_chunks, mixing, ngram_join, quality, queries, substring_dedup, token_counts
from valora.llm._components import components

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, equal ids."""
    a, b = words(120, 1), words(80, 2)
    rows = [
        (1, a, "en", "x", 5), (2, a, None, "x", 5), (2, a, None, "x", 5), (3, None, "en", None, None), (4, "", "fr", "y", 0), (None, b, "fr", "y", 3), (None, None, None, None, None), (5, b + " tail", "en", None, 9),
        (5, "other text of the same id", "fr", "y", 2), (6, LONG, "en", "x", 7), (7, "!!! ... ???", "en", "x", 1), (8, "é" * 30, "fr", "y", 2), (9, " \t\n ", "en", "x", 1), (0, words(60, 3) + " " + a, "en", "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, *values):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(values)], DOCS)


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


SPACED = re.compile(r"[^\x20\x09-\x0D]+")


class TestKernel:
    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(alphabet="ab \n\té日", max_size=12), max_size=8))
    def test_words_and_hashes(self, values):
        batch = pa.record_batch([pa.array(values, pa.string())], names=["t"])
        want = [w for t in values for w in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())]
        got, hashes = [], []
        for _, data, offs in K.texts(batch, "t", 9):
            w = K.words(data, offs)
            got += [data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
            hashes += K.word_hashes(data, w).tolist()
        assert got == want
        assert len(set(hashes)) == len(set(want)) and len({*zip(hashes, want, strict=True)}) == len(set(want))

    def test_windows_are_those_of_the_words(self):
        h = np.arange(10, dtype=np.uint64)
        one, two = K.windows(np.concatenate([h, h]), 4), K.windows(h, 4)
        assert (one[:7] == two).all() and (one[10:] == two).all() and len({*one.tolist()}) == 10
        assert len(K.windows(h, 11)) == 0

    def test_long_texts_are_hashed_by_parts(self, monkeypatch):
        batch = pa.record_batch([pa.array([LONG[:50_000]])], names=["t"])
        _, data, offs = next(K.texts(batch, "t"))
        w = K.words(data, offs)
        h = K.word_hashes(data, w)
        g = K.windows(h, 5)
        monkeypatch.setattr(K, "SEGMENT", 100)
        assert (K.word_hashes(data, w) == h).all() and (K.windows(h, 5) == g).all()

    def test_components(self, spark):
        edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "a long, b long")
        assert {r["node"]: r["label"] for r in components(edges).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}

    def test_attach_both_ways(self, spark):
        a, b = spark.createDataFrame([(1,), (None,)], "k long"), spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")
        for size in (1, S.BROADCAST_BYTES + 1):
            assert {r["k"]: r["v"] for r in S.attach(a, b, ["k"], size).collect()} == {1: "x", None: "y"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(queries.ORACLE[name]).df())


class TestTokenCounts:
    def want(self, values):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
        return [len(model.encode(t or "")) for t in values]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="ab  \n▁é日<s>/.1", max_size=20), max_size=5))
    def test_units_are_safe(self, values):
        counter = token_counts.Counter(MODEL)
        assert counter.by_unit and counter.counts(values) == self.want(values)

    def test_rows(self, spark, odd):
        got = token_counts.count_tokens(odd, MODEL).collect()
        source = odd.select("doc_id", "text").collect()
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n) for r, n in zip(source, self.want([r["text"] for r in source]), strict=True))

    def test_long_units_are_forgotten(self, monkeypatch):
        monkeypatch.setattr(token_counts, "CACHE_CHARS", 300)
        counter = token_counts.Counter(MODEL)
        rng = random.Random(3)
        for _ in range(30):
            values = ["".join(rng.choice("abc日") for _ in range(400)) for _ in range(3)] + [words(20, rng.randint(0, 9)), " a  b "]
            assert counter.counts(values) == self.want(values)
            assert max(map(len, counter.seen)) <= token_counts.CACHE_UNIT and sum(map(len, counter.seen)) < 1000

    def test_batches_are_balanced_by_bytes(self, monkeypatch):
        monkeypatch.setattr(token_counts, "BATCH_BYTES", 100)
        counter = token_counts.Counter(MODEL)
        found = [*counter.batches(["日" * 20, "a" * 60, "b" * 10, "c" * 10])]
        assert sorted(x for b in found for x in b) == sorted(["日" * 20, "a" * 60, "b" * 10, "c" * 10])
        assert all(len(b) == 1 or sum(len(x.encode()) + 16 for x in b) <= 116 for b in found)

    def test_json_tokenizer(self, spark):
        from tokenizers import Tokenizer

        path = tokenizers.path("byte_bpe_50k.json")
        t = ["hello  world <|endoftext|>", "", None, "x" * 50]
        want = [len(Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids) for x in t]
        assert [r["n_tokens"] for r in token_counts.count_tokens(texts(spark, *t), path).orderBy("doc_id").collect()] == want

    def test_empty_table(self, empty):
        assert token_counts.count_tokens(empty, MODEL).count() == 0


class TestSubstringDedup:
    def brute(self, rows):
        last = (1 << 63) - 1
        seen, split = {}, [(last if i is None else i, SPACED.findall(t or "")) for i, t in rows]
        for i, w in split:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                seen[key] = min(seen.get(key, last), i)
        out = []
        for i, w in split:
            gone = {k + j for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] < i for j in range(50)}
            out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
        return sorted(out)

    def got(self, df):
        last = (1 << 63) - 1
        return sorted((last if r["doc_id"] is None else r["doc_id"], r["__n_words"], r["__n_removed"], r["__kept"]) for r in substring_dedup.dedup_substrings(df).collect())

    def test_brute(self, odd):
        assert self.got(odd) == self.brute([(r["doc_id"], r["text"]) for r in odd.collect()])

    def test_shifted_passages_and_edges(self, spark):
        p, q = words(50, 7), words(49, 8)
        rows = [(3, f"a b c {p} z"), (1, f"{p}"), (2, f"x {q} y"), (5, f"k {q} l {p} {p} m"), (4, p + " " + words(30, 9)), (6, words(30, 9) + " " + p), (0, p.split(" ", 1)[1])]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert self.got(df) == self.brute(rows)

    def test_both_sides_of_the_broadcast_bound(self, spark, odd, monkeypatch):
        want = self.got(odd)
        monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
        assert self.got(odd) == want

    def test_common_windows_change_nothing(self, spark, monkeypatch):
        p, q = words(90, 31), words(55, 32)
        rows = [(i, f"{words(i % 7 + 60, 40 + i)} {p if i % 2 else q} {words(5, 90 + i)}") for i in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = self.brute(rows)
        for least in (3, 10_000):
            monkeypatch.setattr(substring_dedup, "COMMON_LEAST", least)
            assert self.got(df) == want
            sizes = {k: len(v) for k, v in substring_dedup.common_windows(substring_dedup._keyed(df), 60).items()}
            assert (min(sizes.values()) > 0) == (least == 3)

    def test_empty_and_clashing(self, spark, empty, odd):
        assert self.got(empty) == []
        clash = odd.withColumns({"lo": F.lit(1), "id": F.lit("q"), "n_words": F.lit(3)})
        kept = substring_dedup.without_repeats(clash)
        assert kept.columns == clash.columns and kept.count() == 14 - 4  # rows 1, 2, 2 and the one without an id lose all their words


class TestNgramJoin:
    def brute(self, rows):
        sets = []
        for _, t in rows:
            w = SPACED.findall(lowered(t))
            sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
        n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)
        for a in range(n):
            for b in range(a):
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    links[a] += 1
                    links[b] += 1
                    x, y = parent[a], parent[b]
                    parent = [y if p == x else p for p in parent]
        first = {}
        last = (1 << 63) - 1
        for k, (i, _) in enumerate(rows):
            first[parent[k]] = min(first.get(parent[k], last), last if i is None else i)
        return sorted((last if i is None else i, first[parent[k]], links[k]) for k, (i, _) in enumerate(rows))

    def got(self, df):
        last = (1 << 63) - 1
        return sorted(tuple(last if x is None else x for x in (r["doc_id"], r["class_id"], r["n_links"])) for r in ngram_join.jaccard_join(df).collect())

    def near(self):
        base = words(150, 11).split()
        rows = []
        for i in range(40):
            w = list(base)
            for j in range(i % 5):
                w[(13 * i + 29 * j) % 150] = f"new{i}{j}"
            rows.append((i, " ".join(w)))
        return rows + [(100 + i, words(40, 50 + i)) for i in range(10)] + [(200, "one two"), (201, "One  two"), (202, None), (203, "")]

    def test_brute(self, spark, odd):
        assert self.got(odd) == self.brute([(r["doc_id"], r["text"]) for r in odd.collect()])

    def test_near_copies_in_blocks(self, spark, monkeypatch):
        rows = self.near()
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = self.brute(rows)
        assert self.got(df) == want
        monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)  # the group is dealt out as pairs of blocks
        assert self.got(df) == want

    def test_first_of_each(self, spark, odd, empty):
        kept = ngram_join.first_of_each(odd)
        assert kept.columns == odd.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert 2 not in ids and collections.Counter(ids)[1] == 1 and ids.count(3) == 1
        assert ngram_join.first_of_each(empty).count() == 0 and ngram_join.jaccard_join(empty).count() == 0
        twice = spark.createDataFrame([(1, "a b c d e f")] * 3, "doc_id long, text string")
        assert ngram_join.first_of_each(twice).count() == 1

    def test_finds_what_an_exact_join_finds(self, spark):
        """All pairs of sf0.01's documents by an index of their n-grams."""
        docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
        sets, index = {}, collections.defaultdict(list)
        for r in docs.collect():
            w = SPACED.findall(lowered(r["text"]))
            sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
            for g in sets[r["doc_id"]]:
                index[g].append(r["doc_id"])
        links = collections.Counter()
        for i, s in sets.items():
            both = collections.Counter(j for g in s for j in index[g] if j != i)
            links[i] = sum(n >= 0.8 * len(s | sets[j]) for j, n in both.items() if n >= 0.8 * len(s))
        got = {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_join(docs).collect()}
        assert sum(links.values()) > 100 and got == dict(links)

    def test_candidates_share_a_band(self):
        rng = np.random.default_rng(2)
        a, b = rng.integers(0, 4, (9, 3)), rng.integers(0, 4, (7, 3))
        every, found = ngram_join.candidates(a, b, -1), [ngram_join.candidates(a, b, k) for k in range(3)]
        assert (every == (a[:, None, :] == b[None, :, :]).any(2)).all()
        assert (sum(x.astype(int) for x in found) == every).all()  # each pair once

    def test_banding_finds_what_it_should(self):
        bands, rows = ngram_join.banding(0.8, 0.999)
        assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.999

    @settings(max_examples=40, deadline=None)
    @given(st.lists(st.sets(st.integers(0, 30), max_size=20), min_size=1, max_size=6), st.lists(st.sets(st.integers(0, 30), max_size=20), min_size=1, max_size=6))
    def test_overlaps(self, a, b):
        def arrays(sets):
            return [np.array(sorted(x), np.uint64) for x in sets]

        if any(a) or any(b):
            assert ngram_join.overlaps(arrays(a), arrays(b)).tolist() == [[len(x & y) for y in b] for x in a]


class TestDecontaminate:
    def bench(self, spark, *values):
        return spark.createDataFrame(list(enumerate(values)), "item_id long, text string")

    def test_substitutions(self, spark):
        item = words(30, 21).split()
        changed = list(item)
        changed[5], changed[14], changed[22] = "q1", "q2", "q3"
        far = [w if k % 3 else "zz" for k, w in enumerate(item)]
        df = texts(spark, "a " + " ".join(item).upper() + " b", "c " + " ".join(changed) + " d", " ".join(far), words(200, 22), " ".join(item[:12]), " ".join(item[4:17]), None, "")
        got = {r["doc_id"]: r["item_id"] for r in decontaminate.contaminated(df, self.bench(spark, " ".join(item), "one two three", None)).collect()}
        assert got == {0: 0, 1: 0, 5: 0}

    def test_any_two_differences_are_hit(self):
        item = np.arange(13, dtype=np.uint64) + np.uint64(100)
        want = [decontaminate.seeds(item, m) for m in range(3)]
        for a in range(13):
            for b in range(a):
                other = item.copy()
                other[[a, b]] = 1
                assert any((decontaminate.seeds(other, m) == want[m]).any() for m in range(3))

    @pytest.mark.parametrize("n", range(5, 13))
    def test_allowed_differences_of_short_items_are_hit(self, n):
        item = np.arange(n, dtype=np.uint64) + np.uint64(100)
        want = decontaminate.short_seeds(item, n)
        off = n - math.ceil(n * 8 / 10)
        for k in range(off + 2):
            for places in itertools.combinations(range(n), k):
                other = item.copy()
                other[list(places)] = 1
                hit = any((a == b).any() for a, b in zip(decontaminate.short_seeds(other, n), want, strict=True))
                assert decontaminate.aligned(other, item, 0).any() == (k <= off)
                assert hit or k > off

    def test_changed_short_items_are_found(self, spark):
        item = words(10, 5).split()
        two, three = list(item), list(item)
        two[0] = two[9] = "zz"
        three[0] = three[4] = three[9] = "zz"
        df = texts(spark, "a " + " ".join(two) + " b", " ".join(three), " ".join(item[:9]))
        bench = self.bench(spark, " ".join(item), "one two three", None)
        assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()] == [(0, 0)]
        assert sorted((r["item_id"], r["item_words"]) for r in decontaminate.short_items(bench).collect()) == [(1, 3), (2, 0)]

    def test_short_and_equal_items(self, spark):
        df = texts(spark, "x red green blue white black y", "red green blue white", "nothing")
        got = decontaminate.contaminated(df, self.bench(spark, "Red green, blue white black", "red green blue white black", "the")).collect()
        assert [(r["doc_id"], r["item_id"], r["n_items"], r["first_word"], r["overlap"]) for r in got] == [(0, 0, 2, 1, 1.0)]

    def brute(self, docs, items):
        """Every document against every item, place by place."""
        split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
        by_words = collections.defaultdict(list)
        for i, t in items:
            by_words[tuple(split(t))].append(i)
        out = []
        for d, t in docs:
            w, best, n = split(t), None, 0
            for item, ids in by_words.items():
                if len(item) < 5:
                    continue
                size = min(13, len(item))
                covered, first = set(), None
                for shift in range(-len(item), len(w) + 1):
                    for lo in range(max(0, -shift), min(len(item), len(w) - shift) - size + 1):
                        same = [k for k in range(lo, lo + size) if w[k + shift] == item[k]]
                        if 10 * len(same) >= 8 * size:
                            covered |= {*same}
                            first = min([x for x in (first, same[0] + shift) if x is not None])
                if covered:
                    n += len(ids)
                    found = (len(covered) / len(item), len(item), -min(ids)), (min(ids), len(item), len(covered), first)
                    best = max([x for x in (best, found) if x is not None])
            if best:
                out.append((d, *best[1], n))
        return sorted(out)

    def test_random_documents_against_every_item(self, spark):
        rng = random.Random(17)
        word = lambda: rng.choice("abcdefghijkl") * rng.randint(1, 3)
        items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 7, 9, 10, 11, 12, 13, 14, 20, 30, 30, 60])]
        items += [(90, items[8][1]), (91, items[10][1] + " " + items[9][1])]
        docs = []
        for d in range(160):
            w = [word() for _ in range(rng.randint(0, 40))]
            for _ in range(rng.randint(0, 2)):
                part = rng.choice(items)[1].split()
                cut = rng.randint(0, max(0, len(part) - 13)) if rng.random() < 0.5 else 0
                part = [word() if rng.random() < 0.12 else x for x in part[cut:]]
                at = rng.randint(0, len(w))
                w[at:at] = part
            docs.append((d, " ".join(w)))
        want = self.brute(docs, items)
        df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = decontaminate.contaminated(df, bench).collect()
        assert len(want) > 60
        assert sorted((r["doc_id"], r["item_id"], r["item_words"], r["same_words"], r["first_word"], r["n_items"]) for r in got) == want

    def test_many_items_of_one_document(self, spark, monkeypatch):
        shared = words(15, 41)
        bench = self.bench(spark, *[f"{shared} {words(20, 500 + i)}" for i in range(50)])
        df = texts(spark, f"x {shared} y", "x", f"{shared} {words(20, 507)}")
        for n in (32, 3):
            monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", n)
            got = sorted((r["doc_id"], r["item_id"], r["n_items"]) for r in decontaminate.contaminated(df, bench).collect())
            assert got == [(0, 0, 50), (2, 7, 50)]

    def test_edges(self, spark, odd, empty):
        bench = self.bench(spark, odd.where("doc_id = 1").first()["text"], "")
        got = sorted(r["doc_id"] for r in decontaminate.contaminated(odd, bench).collect())
        assert got == [0, 1, 2]
        assert decontaminate.clean(odd, bench).count() == 10 and decontaminate.clean(odd, bench).columns == odd.columns
        assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.clean(odd, self.bench(spark, "")).count() == 14


class TestLicenseScan:
    def brute(self, text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))

    def test_base(self, spark, odd):
        df = texts(spark, "MIT License, mit-license; the MIT\nlicense general public license", "Apache  License", "the mit licence", "mitlicense K MIT LICENSE", None, "", "general public general public license", "K mit license")
        for frame in (df, odd):
            source = {(r["doc_id"], r["text"]) for r in frame.collect()}
            got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.scan(frame).collect())
            assert set(got) == {(i, *self.brute(t)) for i, t in source}

    def test_labels_of_its_own(self, spark):
        notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        df = texts(spark, notice, notice.replace("hereby ", "").replace("copy", "clone"), "licensed under CC BY-NC 4.0", "permission is granted", notice.upper() + " mit license")
        got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in license_scan.scan(df).collect()}
        assert got == {0: ("mit", ""), 1: ("mit", ""), 2: ("cc-by-nc", ""), 3: ("", ""), 4: ("mit", "mit")}

    def best_stretch(self, text):
        """By label the largest share of each notice: all diagonals of a stretch, for every first diagonal."""
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        out = {}
        for notice, label in license_scan.NOTICES.items():
            t = notice.split()
            drift = int(len(t) * 0.5) + 3
            hits = collections.defaultdict(set)
            for i in range(len(w) - 1):
                for j in range(len(t) - 1):
                    if w[i : i + 2] == t[j : j + 2]:
                        hits[i - j].add(j)
            diagonals = sorted(hits)
            for k, first in enumerate(diagonals):
                found, last = set(), first
                for d in diagonals[k:]:
                    if d - last > 3 or d - first > drift:
                        break
                    found |= hits[d]
                    last = d
                share = len(found | {j + 1 for j in found}) / len(t)
                out[label] = max(out.get(label, 0), share)
        return out

    def test_labels_against_every_stretch(self, spark):
        rng = random.Random(8)
        notices, values = [*license_scan.NOTICES], []
        for _ in range(120):
            w = []
            for _ in range(rng.randint(1, 3)):
                t = rng.choice(notices).split()
                t = [x for x in t if rng.random() > rng.choice([0, 0, 0.1, 0.2])]
                for _ in range(rng.choice([0, 0, 1, 3, 8])):
                    t.insert(rng.randint(0, len(t)), rng.choice([*t, "zz", "qq"]) if t else "zz")
                if rng.random() < 0.5:  # some of its words again and again before or after it
                    lo = rng.randint(0, max(0, len(t) - 3))
                    again = t[lo : lo + rng.randint(2, 4)] * rng.randint(2, 15)
                    t = again + t if rng.random() < 0.5 else t + again
                w += t + ["word"] * rng.randint(0, 5)
            values.append(" ".join(w))
        values.append("under the " * 15 + "licensed under the apache license version 2 0")
        got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(texts(spark, *values)).collect()}
        for i, t in enumerate(values):
            shares, base = self.best_stretch(t), self.brute(t)[4]
            labels = {x for x, share in shares.items() if share >= 0.8} | {x for x in base.split(",") if x}
            score = 1.0 if base else max([x for x in shares.values() if x >= 0.5], default=0.0)
            assert got[i] == (",".join(sorted(labels)), pytest.approx(score)), t
        assert "apache-2.0" in got[len(values) - 1][0]
        assert sum("," in x for x, _ in got.values()) > 10 and sum(not x for x, _ in got.values()) > 10

    def test_empty(self, empty):
        assert license_scan.scan(empty).count() == 0


class TestMixing:
    def level(self, sizes):
        names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
        w = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
        want, free, cap = 1.5 * sum(sizes.values()), set(names), {n: 2.0 * s for n, s in sizes.items()}
        while free:
            level = (want - sum(cap[n] for n in cap if n not in free)) / sum(w[n] for n in free)
            over = {n for n in free if level * w[n] > cap[n]}
            if not over:
                break
            free -= over
        return {n: level * w[n] if n in free else cap[n] for n in names}

    @pytest.mark.parametrize("cell", [50_000, 7])
    def test_targets_are_met(self, spark, monkeypatch, cell):
        monkeypatch.setattr(mixing, "CELL_ROWS", cell)
        rng = random.Random(4)
        rows = [(i, words(rng.choice([0, 3, 5, 5, 40]), i) if i % 11 else None, rng.choice(["b", "a", "c", None, "b", "b"])) for i in range(300)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mixing.mix(df).collect()
        sizes = collections.Counter()
        for _, t, s in rows:
            sizes[s] += len(SPACED.findall(t or ""))
        want = self.level(sizes)
        taken = collections.Counter()
        for r in got:
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]])
        assert len(got) == 300 and all(abs(taken[s] - want[s]) <= 21 for s in want)
        again = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(5)).collect())
        assert again == sorted((r["doc_id"], r["taken"]) for r in got)

    def test_copies_are_those_of_the_running_rates(self, spark):
        rng = random.Random(5)
        rows = [(i, words(rng.choice([1, 2, 5, 5, 9, 30]), i), rng.choice(["a", "b", "b", None])) for i in range(200)]
        got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        for source in ("a", "b", None):
            mine = sorted((r for r in got.values() if r["source"] == source), key=lambda r: (-r["size"], r["doc_id"]))
            assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(mine[0]["target"], rel=1e-5)
            logs = [(r["size"], math.log(r["rate"])) for r in mine if r["rate"] < 2]
            assert all(a / x == pytest.approx(logs[0][1] / logs[0][0], rel=1e-6) for x, a in logs)  # one multiplier
            done = 0.0
            for r in mine:
                before, done = done, done + r["rate"]
                assert r["copies"] == min(2, max(0, math.floor(done + 0.5 + 1e-9) - math.floor(before + 0.5 + 1e-9)))
                assert r["taken"] == r["copies"] * r["size"]

    def test_many_sources_are_numbered_by_code_point(self, spark):
        names = ["b", "a", "Z", "é", "", "zz", "日本", "a b", None, *[f"s{i}" for i in range(80)]]
        df = spark.createDataFrame([(n, 10 + len(n or "")) for n in names], "__source string, size long")
        want = sorted(n for n in names if n is not None) + [None]
        assert [r["__source"] for r in sorted(mixing.ranked(df).collect(), key=lambda r: r["nth"])] == want
        assert [r["nth"] for r in sorted(mixing.ranked(df).collect(), key=lambda r: r["nth"])] == [*range(len(names))]
        level = self.level({n: 10 + len(n or "") for n in names})
        assert {r["__source"]: r["target"] for r in mixing.targets(df).collect()} == pytest.approx(level)

    def test_a_source_that_is_not_solved_raises(self, spark, monkeypatch):
        monkeypatch.setattr(mixing, "ROUNDS", 1)
        rows = [(i, words(i % 9 + 1, i), "ab"[i % 2]) for i in range(30)] + [(99, words(400, 3), "b")]
        with pytest.raises(ArithmeticError):
            mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))

    def test_edges(self, odd, empty):
        got = mixing.mix(odd).collect()
        assert len(got) == 14 and all(r["taken"] <= 2 * r["size"] for r in got)
        assert mixing.mix(empty).count() == 0


class TestLanguageId:
    def test_held_out(self, spark):
        got = language_id.op1_language_id(spark, SF)
        lang = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("d"), "lang")
        held = got.join(lang, F.col("doc_id") == F.col("d")).where("held_out")
        right, n = held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
        assert right >= 0.95 and n > 30
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got.collect())

    def test_edges(self, spark, odd, empty):
        model = language_id.train(odd.where(F.col("lang").isNotNull()))
        got = language_id.identify(odd, model).collect()
        assert len(got) == 14 and sum(r["lang_pred"] == "und" and r["score"] == 0 for r in got) == 5
        none = language_id.train(empty)
        assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
        single = language_id.train(odd.where("lang = 'fr'"))
        assert {(r["lang_pred"], r["score"]) for r in language_id.identify(odd, single).collect()} == {("fr", 1.0), ("und", 0.0)}
        assert language_id.identify(empty, model).count() == 0

    def test_decoding_takes_the_cheapest_codeword(self):
        rng = np.random.default_rng(6)
        for n in (2, 3, 5, 8):
            x = np.abs(rng.normal(size=(60, 16))).astype(np.float32)
            y = np.arange(60) % n
            x[np.arange(60), y] += 4
            m = language_id.Model([f"l{k}" for k in range(n)], x, y)
            best, score, gap = m.decode(x)
            for i in range(60):
                bits = [float(x[i] @ m.w[:, k] + m.b[k]) for k in range(m.code.shape[1])]
                cost = [sum(m.weight[k] * math.log1p(math.exp(-max(-30, min(30, v)) * word[k])) for k, v in enumerate(bits)) for word in m.code]
                order = sorted(cost)
                assert cost[best[i]] == pytest.approx(order[0], rel=1e-4, abs=1e-6) and gap[i] == pytest.approx(order[1] - order[0], rel=1e-3, abs=1e-4)
                assert score[i] == pytest.approx(1 / sum(math.exp(order[0] - c) for c in cost), rel=1e-3)
            assert (best == y).mean() > 0.9

    def test_every_language_can_be_predicted(self, spark):
        rows = [(i * 10 + j, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, f"l{i:03}") for i in range(300) for j in range(2)]
        model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert len(model.languages) == 300

    @pytest.mark.parametrize("n", [2, 4, 5, 9, 30])
    def test_codewords_are_apart(self, n):
        code = language_id.codewords(n)
        apart = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert apart >= max(1, code.shape[1] // 4)


class TestQuality:
    def test_held_out(self, spark):
        sf = SF.replace("sf0.001", "sf0.01")
        got = quality.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).where("held_out")
        assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.95
        assert got.where("predicted <> cast(score >= 0.7 as int)").count() == 0

    def test_edges(self, spark, odd, empty):
        labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (6, 0), (99, 1)], "doc_id long, quality int")
        scored = quality.score(odd, quality.train(odd, labels), ["doc_id"]).collect()
        assert len(scored) == 14 and all(0 <= r["__score"] <= 1 for r in scored)
        assert quality.score(empty, quality.train(odd, labels), ["doc_id"]).count() == 0
        assert {r["__score"] for r in quality.score(odd, quality.train(odd, labels.limit(0)), ["doc_id"]).collect()} == {1.0} or min(r["__score"] for r in quality.score(odd, quality.train(odd, labels.limit(0)), ["doc_id"]).collect()) > 0.99
        assert max(r["__score"] for r in quality.score(odd, quality.train(odd, labels.where("quality = 0 and doc_id = 6")), ["doc_id"]).collect()) < 0.01

    def test_walk_is_that_of_each_tree(self):
        rng = np.random.default_rng(4)
        x = rng.normal(size=(300, 5))
        trees = quality.grow(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), np.ones(300))
        for row, got in zip(x, trees.predict(x), strict=True):
            total = trees.base
            for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
                node = 0
                for _ in range(quality.DEPTH):
                    node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
                total += leaf[node - (2**quality.DEPTH - 1)]
            assert got == pytest.approx(1 / (1 + math.exp(-total)))

    def test_statistics_are_those_of_the_text(self):
        values = ["One two two, three!\nfour 5x $ AB", "", "ééé a a a", "x" * 300]
        batch = pa.record_batch([pa.array(values)], names=["t"])
        _, data, offs = next(K.texts(batch, "t"))
        for t, row in zip(values, quality.statistics(data, offs), strict=True):
            got, w, raw = dict(zip(quality.NAMES, row, strict=True)), SPACED.findall(t), t.encode()
            n = max(len(w), 1)
            low = collections.Counter(lowered(x) for x in w)
            want = {
                "bytes": math.log1p(len(raw)), "words": math.log1p(len(w)), "word_length": sum(len(x.encode()) for x in w) / n, "upper": sum(65 <= b < 91 for b in raw) / max(len(raw), 1),
                "digits": sum(48 <= b < 58 for b in raw) / max(len(raw), 1), "high": sum(b > 127 for b in raw) / max(len(raw), 1), "distinct": len(low) / n, "top_word": max(low.values(), default=0) / n,
                "stutter": sum(lowered(a) == lowered(b) for a, b in zip(w[:-1], w[1:], strict=True)) / n, "entropy": -sum(c / len(raw) * math.log2(c / len(raw)) for c in collections.Counter(raw).values()),
                "digit_words": sum(any(c.isascii() and c.isdigit() for c in x) for x in w) / n, "alone_words": sum(len(x.encode()) == 1 for x in w) / n,
            }
            assert {k: got[k] for k in want} == pytest.approx(want)

    def test_trees_separate(self):
        rng = np.random.default_rng(3)
        x = rng.normal(size=(600, 4))
        y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
        trees = quality.grow(x, y, np.ones(600))
        assert ((trees.predict(x) > 0.5) == y).mean() > 0.97


class TestLmScore:
    def test_base_is_brute_force(self, spark, odd):
        df = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(odd.columns).limit(40))
        docs = [(r["doc_id"], SPACED.findall(lowered(r["text"])) + [None]) for r in df.collect()]
        trains = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
        c = collections.Counter(w for i, ws in docs for w in ws if trains(i))
        total, distinct = sum(c.values()), len(c)
        want = collections.Counter()
        for i, ws in docs:
            want[i, not trains(i), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), 3)] += 1
        model = lm_score.fit(df.where(S.crc_mod(F.col("doc_id"), 7) != 2), MODEL)
        got = lm_score.score(df, MODEL, model).collect()
        assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
        assert all(r["score"] < 0 for r in got)

    def test_probabilities_add_up(self):
        rng = np.random.default_rng(1)
        counts = np.sort(rng.integers(0, 900, 3000))[::-1].astype(np.int64)
        m = lm_score.Attention(counts, rng.random(3000) < 0.4)
        ids = rng.integers(0, 3000, 40).astype(np.int32)
        at = np.array([0, 40])
        seq, first, _ = lm_score.windows(at)
        x = m.inputs(ids, at, seq, first)
        target = np.arange(lm_score.CLASSES)
        p = np.zeros((len(x), lm_score.STEP))
        for c in target:
            p += np.exp(m.log_classes(x, np.full((len(x), lm_score.STEP), c)))
        assert np.allclose(p, 1, atol=1e-4)
        within = np.bincount(m.cls, weights=np.exp(m.within), minlength=lm_score.CLASSES)
        assert np.allclose(within[np.bincount(m.cls, minlength=lm_score.CLASSES) > 0], 1, atol=1e-4)

    def test_scores_do_not_see_what_follows(self):
        counts = np.arange(3000, 0, -1)
        m = lm_score.Attention(counts, np.zeros(3000, bool))
        ids = np.random.default_rng(2).integers(0, 3000, 100).astype(np.int32)
        long, at = m.score(ids, np.array([0, 100]))[0], lm_score.STEP * 3
        parts = m.score(ids[:at], np.array([0, at]))[0]
        changed = ids.copy()
        changed[at:] = 5
        seq_a, seq_b = m.score(ids[: at + 1], np.array([0, at + 1]))[0], m.score(np.append(ids[:at], 7).astype(np.int32), np.array([0, at + 1]))[0]
        assert long < parts and seq_a < parts and seq_b < parts
        both = m.score(np.concatenate([ids, changed]), np.array([0, 100, 200]))
        assert both[0] == pytest.approx(long, rel=1e-5)

    def test_training_helps_and_empty_works(self, spark, empty):
        df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
        model = lm_score.fit(df, MODEL)
        plain = lm_score.fit(df.limit(0), MODEL)
        a, b = (lm_score.score(df, MODEL, m).agg(F.sum("score")).first()[0] for m in (model, plain))
        assert a > 0.7 * b
        assert lm_score.score(empty, MODEL, model).count() == 0

    def test_every_window_is_learned_from(self, spark):
        df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
        model = lm_score.fit(df, MODEL)
        pieces = [r["n_pieces"] for r in lm_score.score(df, MODEL, model).collect()]
        assert model.learned == sum(-(-n // lm_score.STEP) for n in pieces) > 2 * len(pieces)

    def test_windows_are_shared_out_by_documents(self):
        m = lm_score.Attention(np.arange(3000, 0, -1), np.zeros(3000, bool))
        ids = np.random.default_rng(3).integers(0, 3000, 700).astype(np.int32)
        at = np.array([0, 10, 60, 500, 700])
        seq, every = m.windows(ids, at)
        found = [m.windows(ids, at, np.full(4, k), 3) for k in range(3)]
        assert sorted(map(tuple, np.concatenate([x[1][x[0] > 1] for x in found]))) == sorted(map(tuple, every[seq > 1]))  # each window of a long text once
        assert all(set(x[0]) == {0, 1, 2, 3} for x in found)

    def test_windows_hold_what_stands_before_each_place(self):
        m = lm_score.Attention(np.arange(3000, 0, -1), np.zeros(3000, bool))
        ids = np.random.default_rng(3).integers(0, 3000, 130).astype(np.int32)
        at = np.array([0, 1, 60, 130])
        seq, both = m.windows(ids, at)
        for row, k, first in zip(both, seq, lm_score.windows(at)[1], strict=True):
            for j in range(lm_score.CONTEXT + lm_score.STEP):
                place = first - lm_score.CONTEXT + j
                want = m.begin if place == at[k] else m.input[ids[place - 1]] if at[k] < place < at[k + 1] else m.pad
                assert row[j] == want
            target = row[lm_score.CONTEXT + lm_score.STEP :]
            assert target.tolist() == [m.cls[ids[p]] if p < at[k + 1] else -1 for p in range(first, first + lm_score.STEP)]

    def test_gradients_are_those_of_the_loss(self):
        rng = np.random.default_rng(5)
        m = lm_score.Attention(rng.integers(0, 900, 3000), rng.random(3000) < 0.4)
        m.follow(rng.integers(0, 3, lm_score.INPUTS * lm_score.CLASSES))
        ids = rng.integers(0, 3000, 100).astype(np.int32)
        _, both = m.windows(ids, np.array([0, 30, 100]))
        x, target = both[:, : lm_score.CONTEXT + lm_score.STEP], both[:, lm_score.CONTEXT + lm_score.STEP :]
        scored = (target >= 0).astype(np.float32)
        m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
        loss = lambda: -(m.log_classes(x, np.maximum(target, 0)) * scored).sum(dtype=float) / scored.sum()
        grads = m.gradients(x, np.maximum(target, 0), scored)
        for k, cell in (("ask", (x[0, 10], 3)), ("ask", (x[1, 9], lm_score.HALF + 1)), ("give", (x[0, 9], 5)), ("give", (x[1, 12], lm_score.HALF + 2)), ("G", (4, 7)), ("M", (2, 5, 6)), ("lag", (1,))):
            was = m.p[k][cell]
            up, down = (m.p[k].__setitem__(cell, was + d) or loss() for d in (0.02, -0.02))
            m.p[k][cell] = was
            assert grads[k][cell] == pytest.approx((up - down) / 0.04, rel=0.05, abs=2e-5), (k, cell)
        assert not grads["ask"][:, [lm_score.WIDTH, -1]].any() and not grads["give"][:, [lm_score.WIDTH, -1]].any()

    @pytest.mark.parametrize("at", [[7] * 700, list(range(50)), [0, 3, 0], [9]])
    def test_rows_are_added_up_by_index(self, at):
        rng = np.random.default_rng(6)
        at = np.concatenate([at, rng.zipf(1.4, 500) % 300]) if len(at) > 3 else np.array(at)
        rows = rng.normal(size=(len(at), 5)).astype(np.float32)
        found, got = lm_score._scattered(at, rows)
        want = np.zeros((found.max() + 1, 5))
        np.add.at(want, at, rows)
        assert found.tolist() == sorted(set(at.tolist())) and np.allclose(got, want[found], atol=1e-4)

    def test_adam_takes_the_steps_of_its_definition(self):
        rng = np.random.default_rng(7)
        p, adam, mean, square = {"x": np.zeros((3, 4), np.float32)}, lm_score.Adam(), 0.0, 0.0
        want = np.zeros((3, 4))
        for step in range(1, 30):
            grad = rng.normal(size=(3, 4)).astype(np.float32) * (rng.random((3, 4)) < 0.5)
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad.astype(float) ** 2
            want -= 0.01 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
            adam.step(p, {"x": grad.copy()}, 0.01)
        assert np.allclose(p["x"], want, rtol=1e-3, atol=1e-5)

    def test_ids_ranked_under_212_have_their_own_class(self):
        m = lm_score.Attention(np.arange(3000, 0, -1), np.zeros(3000, bool))
        assert m.cls[:212].tolist() == list(range(212)) and m.cls[212:].min() >= 212

    def test_every_training_window_is_learned(self, spark, monkeypatch):
        df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
        monkeypatch.setattr(lm_score, "SAMPLE", 5)
        monkeypatch.setattr(lm_score, "STEPS", 20)
        tokens = lm_score.tokenised(df, MODEL)
        tokens.rows = tokens.rows.withColumn("trains", F.lit(True))
        n = np.array([-(-r["n"] // (2 * lm_score.STEP)) for r in tokens.rows.select(F.octet_length("ids").alias("n")).collect()])
        learned = lm_score.fit_tokens(tokens).learned  # each document's share of its windows, one at least
        assert max(len(n), n.sum() // lm_score.LEARN_EVERY) <= learned <= (n // lm_score.LEARN_EVERY + 1).sum()
        monkeypatch.setattr(lm_score, "LEARN_EVERY", 1)
        few = lm_score.fit_tokens(tokens)
        assert few.learned == n.sum()
        monkeypatch.setattr(lm_score, "LATER_RATE", 0.0)
        start = lm_score.fit_tokens(tokens)
        a, b = (lm_score.score(df, MODEL, m).agg(F.sum("score")).first()[0] for m in (few, start))
        assert a > b

    def test_word_table(self):
        import sentencepiece

        tokens = lm_score.Subwords(MODEL)
        values = [words(300, k) for k in range(4)] + ["", "é 日本 <s> x"]
        batch = pa.record_batch([pa.array(values)], names=["t"])
        plain = sentencepiece.SentencePieceProcessor(model_file=MODEL)
        for _, data, offs in K.texts(batch, "t"):
            w = K.words(data, offs)
            ids, at, _ = tokens.sequences(data, w, K.word_hashes(data, w, K.LOWER))
            for k, t in enumerate(values):
                assert ids[at[k] : at[k + 1]].tolist() == [i for x in SPACED.findall(lowered(t)) for i in plain.encode(x)] + [lm_score.END]


class TestMediaChunks:
    def test_round_trip(self, odd, spark):
        got = media_chunks.read_media(media_chunks.store_media(odd)).collect()
        by = {r["payload_sha256"]: r for r in got}
        assert len(got) == 14
        for r in odd.collect():
            raw = (r["text"] or "").encode()
            size = max(576, -(-len(raw) // 576) * 576)
            payload = raw + b"\xff" * (size - len(raw))
            g = by[hashlib.sha256(payload).hexdigest()]
            assert (g["n_bytes"], g["payload_bytes"], g["tail_crc32"]) == (len(raw), size, zlib.crc32(payload[-32:]))
        assert len({(r["payload_sha256"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in got}) == len(by)

    def chunked(self, payload):
        """Cut points by the definition: a hash of the last 32 bytes with nine leading zeros, 128 to 4096 bytes apart."""
        ends, last = [], 0
        for p in range(1, len(payload) + 1):
            h = 0
            for b in payload[max(0, p - 32) : p]:
                h = (2 * h + int(media_chunks._GEAR[b])) & 0xFFFFFFFF
            if p - last == 4096 or (p - last >= 128 and h >> 23 == 0):
                ends.append(p)
                last = p
        return ends if last == len(payload) else [*ends, len(payload)]

    def test_stored_form_and_features_by_brute_force(self, spark):
        values = [words(300, 3), "é" * 400, "", words(900, 4) + "\n" + words(300, 3)]
        got = {r["id"]: r for r in media_chunks.read_media(media_chunks.store_media(texts(spark, *values))).collect()}
        for i, t in enumerate(values):
            raw = t.encode()
            payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            edges = [0, *self.chunked(payload)]
            parts = [payload[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            form = b"".join(len(p).to_bytes(4, "big") + hashlib.sha256(p).digest() for p in parts) + payload
            n, mean = len(payload), sum(payload) / len(payload)
            counts = collections.Counter(payload)
            feature = {
                "chunks": len(parts), "mean": round(mean, 4), "std": round(math.sqrt(sum((b - mean) ** 2 for b in payload) / n), 4),
                "entropy": round(-sum(c / n * math.log2(c / n) for c in counts.values()), 4), "bands": [sum(c for b, c in counts.items() if b // 32 == k) for k in range(8)],
            }
            assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
            found = json.loads(got[i]["feature"])
            assert found.keys() == feature.keys() and all(found[k] == pytest.approx(v, abs=2e-4) for k, v in feature.items())

    def test_shared_chunks_are_stored_once(self, spark):
        a = LONG[:60_000]
        df = texts(spark, a, "some head " + a, a + " some tail", a)
        store = media_chunks.store_media(df)
        assert store.agg(F.sum(F.length("own"))).first()[0] < 1.2 * len(a)
        assert media_chunks.read_media(store).count() == 4

    def test_a_damaged_chunk_is_found(self, spark):
        store = media_chunks.store_media(texts(spark, LONG[:9000]))
        bad = store.withColumn("own", F.concat(F.lit(b"?"), F.substring("own", 2, 100_000)))
        with pytest.raises(Exception, match="does not match its digest"):
            media_chunks.read_media(bad).collect()

    @settings(max_examples=20, deadline=None)
    @given(st.binary(max_size=20_000))
    def test_chunks_cover_the_payload(self, raw):
        data = np.frombuffer(raw + b"x", np.uint8)
        ends = media_chunks.cuts(data, np.array([0, len(data)]))[0]
        sizes = np.diff(np.append(0, ends))
        assert ends[-1] == len(data) and (sizes <= media_chunks.MOST).all() and (sizes[:-1] >= media_chunks.LEAST).all()

    def test_empty(self, empty):
        assert media_chunks.read_media(media_chunks.store_media(empty)).count() == 0


class TestNames:
    """Columns called like the operators' own, and ids that are no integers."""

    @pytest.fixture(scope="class")
    def clash(self, spark, odd):
        names = ["__id", "__th", "__fp", "__text", "__score", "__kept", "n_bytes", "n_words", "id", "th", "row", "item", "score", "hash", "node", "c0", "__l", "nth", "size", "a.b", "__source", "unit", "lo", "hi"]
        return odd.withColumns({n: F.lit(k) for k, n in enumerate(names)})

    def test_kept_columns(self, spark, clash):
        labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0)], "doc_id long, quality int")
        bench = spark.createDataFrame([(1, clash.where("doc_id = 1").first()["text"])], "item_id long, text string")
        plain = clash.drop("__kept")
        for df, done in ((clash, ngram_join.first_of_each), (clash, substring_dedup.without_repeats), (plain, substring_dedup.dedup_substrings), (clash, lambda d: decontaminate.clean(d, bench)), (clash, lambda d: quality.good(d, labels))):
            got = done(df)
            assert got.columns[: len(df.columns)] == df.columns
            row = got.where("doc_id = 6").first() or got.where("doc_id = 3").first()
            assert [row[c] for c in df.columns[5:]] == [clash.columns.index(c) - 5 for c in df.columns[5:]]
        for bad in (lambda: substring_dedup.dedup_substrings(clash), lambda: quality.score(clash, quality.train(clash, labels), ["__score"]), lambda: token_counts.count_tokens(clash, MODEL, keep=("n_bytes",))):
            with pytest.raises(ValueError, match="__kept|__score|n_bytes"):
                bad()

    def test_other_columns_are_not_read(self, spark, clash, odd):
        model = language_id.train(clash.where(F.col("lang").isNotNull()))
        order = lambda df: sorted(map(str, df.collect()))
        assert order(language_id.identify(clash, model)) == order(language_id.identify(odd, model))
        assert order(license_scan.scan(clash)) == order(license_scan.scan(odd)) and order(mixing.mix(clash)) == order(mixing.mix(odd))
        assert order(ngram_join.jaccard_join(clash)) == order(ngram_join.jaccard_join(odd))
        read = lambda df: order(media_chunks.read_media(media_chunks.store_media(df)))
        assert read(clash) == read(odd)
        lm = lm_score.fit(odd, MODEL)
        assert order(lm_score.score(clash, MODEL, lm)) == order(lm_score.score(odd, MODEL, lm))
        counted = token_counts.count_tokens(clash, MODEL, keep=("doc_id", "a.b", "__text"))
        assert counted.columns == ["doc_id", "a.b", "__text", "n_bytes", "n_tokens"] and counted.count() == 14

    def test_ids_that_are_no_integers(self, spark):
        named = spark.createDataFrame([("x", "a b c", "s")], "doc_id string, text string, source string")
        last = spark.createDataFrame([((1 << 63) - 1, "a b c d e f")], "doc_id long, text string")
        bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
        for use in (ngram_join.jaccard_join, substring_dedup.dedup_substrings, media_chunks.store_media, lambda d: decontaminate.contaminated(d, bench), lambda d: lm_score.fit(d, MODEL)):
            with pytest.raises(TypeError, match="integer"):
                use(named)
        with pytest.raises(Exception, match="stands for null"):
            ngram_join.jaccard_join(last).collect()
        assert mixing.mix(named).count() == license_scan.scan(named).count() == token_counts.count_tokens(named, MODEL).count() == 1


class TestPipeline:
    def test_odd_rows_and_extra_columns(self, spark, odd, empty, tmp_path):
        import corpus_pipeline as C

        wide = odd.withColumns({"a.b": F.lit(1), "id": F.lit("x"), "lo": F.col("doc_id"), "hash": F.lit(2.0), "words": F.array(F.lit(1))})
        spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, words(40, 77)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        for first in (wide, wide.limit(0)):
            docs = first
            for _, stage in C.STAGES[:-1]:
                out = S.cut(stage(spark, docs, str(tmp_path)))
                assert out.columns == wide.columns and out.count() <= docs.count()
                docs = out
            assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()

    def test_stages(self, spark):
        import corpus_pipeline as C

        docs = spark.read.parquet(f"{SF}/documents.parquet")
        before = docs.count()
        for k, (_, stage) in enumerate(C.STAGES):
            out = S.cut(stage(spark, docs, SF))
            assert out.count() <= docs.count()
            if k < len(C.STAGES) - 1:
                assert out.columns == docs.columns
                docs = out
        assert docs.count() > 0.6 * before
        assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        assert ngram_join.jaccard_join(docs).where("n_links > 0").count() <= 2  # texts that stage three has shortened
        assert sorted(map(tuple, C.run(spark, SF).select("doc_id", "taken").collect())) == sorted(map(tuple, out.select("doc_id", "taken").collect()))


def test_bins_bound():
    assert _bins.bins_for(0) == 12 and _bins.bins_for(1 << 50) <= 60_000
