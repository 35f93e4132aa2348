"""Operators on documents against brute force, and the cases that every one of them must take: nulls in any column, empty
and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivane.llm import langid, mixing, ngram_join, packing, pii, queries, sharding, toxicity
from trivane.llm.common import components, held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _h long, shard string, `a.b` string"


def words(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(80, 1)
    toks = base.split()
    near = " ".join(["x" if k == 40 else t for k, t in enumerate(toks)])
    data = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "fr", "b"),
        (4, None, None, None),
        (5, "", "en", "a"),
        (6, "  \n ", "de", None),
        (None, words(40, 2), "en", "b"),
        (None, words(40, 2), "en", "b"),
        (7, words(60000, 3), "en", "a"),
        (8, "mail a.b@c.de, card 4111 1111 1111 1111, ip 10.0.0.1, call +1 (212) 555-1234 now", "en", "c"),
        (9, "日本語 テキスト 🙂", None, "c"),
        (10, words(3, 9), "en", "b"),
    ]
    rows = [(i, t, g, s, None if t is None else len(t), 0.5, 7, "x", "y") for i, t, g, s in data]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# sharding


def test_sharding_laws(spark, docs, none):
    assert sharding.shard(none).count() == 0
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        assert 0 <= r["shard"] < 40 and (r["grown_shard"] in (r["shard"], 40)) and r["law"] == "key"
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 2}) == 1
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_sharding_is_balanced_and_growth_moves_only_into_the_new_shard(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    t = ids
    for n in (40, 41, 42, 43):
        t = sharding.assign(t, "doc_id", sharding.layout(n), f"s{n}")
    rows = t.collect()
    n = np.bincount([r["s40"] for r in rows], minlength=40)
    assert n.min() > 380 and n.max() < 640
    for a in (40, 41, 42):
        moved = [r for r in rows if r[f"s{a}"] != r[f"s{a + 1}"]]
        assert moved and all(r[f"s{a + 1}"] == a for r in moved) and len(moved) < 20000 * 1.4 / (a + 1)


def test_weights_of_a_subtree_confine_movement(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    old = sharding.Tree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0),)))
    new = sharding.Tree((((1.0, 1.0), (1.0, 0.0)), ((1.0, 1.0),)))
    rows = sharding.assign(sharding.assign(ids, "doc_id", old, "a"), "doc_id", new, "b").collect()
    assert all(r["b"] != 3 for r in rows)
    # Shards outside the shrunken one only gain.
    assert all(r["a"] == r["b"] for r in rows if r["a"] in (4, 5))
    assert {r["b"] for r in rows if r["a"] == 3} <= {0, 1, 2, 4, 5}


@pytest.mark.parametrize("same_text", [False, True])
def test_slots_of_one_id(spark, same_text):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.lit(same_text), F.lit("x")).otherwise(F.col("id").cast("string")).alias("text")).union(spark.range(100).select("id", F.lit("y")))
    by = {}
    for r in sharding.shard(df).collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 3100


# mixing


def fill(sizes, weights):
    t, total = dict.fromkeys(sizes, 0.0), sum(sizes.values())
    stopped = set()
    while True:
        free = [s for s in sizes if s not in stopped]
        lam = (total - sum(3 * sizes[s] for s in stopped)) / sum(weights[s] for s in free)
        over = [s for s in free if lam * weights[s] > 3 * sizes[s]]
        if not over:
            return {s: (3.0 * sizes[s] if s in stopped else lam * weights[s]) for s in sizes}
        stopped |= set(over)


@pytest.mark.parametrize("seed", range(4))
def test_mixing_against_water_filling(spark, seed):
    rnd = random.Random(seed)
    data = [(i, " ".join("w" for _ in range(rnd.randint(0, 30))), rnd.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(400)]
    df = spark.createDataFrame([*data, (400, "one", "zz")], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    kept = mixing.mixed(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept} == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


@pytest.mark.parametrize("same_text", [False, True])
def test_a_third_without_ids_does_not_break_the_mix(spark, same_text):
    data = [(None, "word " * (1 + i % 7) + ("" if same_text else f"t{i}"), "a" if i % 2 else "b", i) for i in range(600)]
    data = [(d, "one two three", s, e) for d, t, s, e in data] if same_text else data
    data += [(i, words(3, i), "c", 0) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, extra long").repartition(5)
    got = mixing.mix(df).collect()
    for s in "abc":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
    one, two = ([tuple(r) for r in mixing.mixed(df.repartition(k)).collect()] for k in (3, 7))
    assert sorted(one, key=repr) == sorted(two, key=repr) and len(one) == sum(r["copies"] for r in got)


def test_many_sources_are_mixed(spark):
    data = [(i, "w " * (1 + i % 5), f"s{i % 700}") for i in range(2800)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    sizes = {r["source"]: r["source_size"] for r in got}
    order = sorted(sizes)
    want = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_mixing_edges(spark, docs, none):
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mixed(docs).columns == docs.columns
    zero = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix(zero).collect())


# personal data


def plain_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        s = re.sub("[^0-9]", "", m[0])
        if 12 <= len(s) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(s[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(s, e, pii.BASE[k]) for s, k, e in sorted(out)]


def test_base_spans_against_plain_patterns():
    rnd = random.Random(4)
    for _ in range(3000):
        t = "".join(rnd.choice("aB1239.@+-() %_é4") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(t) == plain_base(t), t
    card = "4111111111111111"
    for t in (f"x {card} y", f"{card[:4]}-{card[4:8]} {card[8:]}", f"{card}1", "a@b.c@d.e", "@@a@b.cc", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "+12 (34) 567-89-01", "+1+2 3456 789 01"):
        assert pii.base_spans(t) == plain_base(t)


def test_patterns_stay_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "GB82 " * 60_000):
        pii.all_spans(t)


def test_many_spans_take_linear_time():
    import time

    took = []
    for n in (4000, 32000):
        t = "+12 345 678 901, 212 555-1234 call; " * n
        began = time.perf_counter()
        assert len(pii.all_spans(t)[1]) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0]


def test_context_decides():
    kinds = lambda t: [k for _, _, k in pii.all_spans(t)[1]]
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    assert kinds(f'token = "{key}"') == ["secret"] and kinds(f"commit {key}") == [] and kinds(f"token of commit {key}") == [] and kinds("token " + "a1" * 20) == []
    assert kinds("ssn 123-45-6789") == ["idnum"] and kinds("part number 123-45-6789") == [] and kinds("ISBN phone 212 555-1234") == []
    # A country without a known length needs a word beside it.
    odd = next(f"QQ{c:02d}12345678901" for c in range(98) if pii.mod97(f"QQ{c:02d}12345678901"))
    assert kinds(f"x {odd} y") == [] and kinds(f"iban {odd} y") == ["iban"]


def test_further_kinds_and_redaction():
    t = "IBAN GB82 WEST 1234 5698 7654 32 ok; GB82 WEST 1234 5698 7654 33 no; phone 212 555-1234 ............................................. 212 555-9999 alone............................; mail q@w.er"
    base, every = pii.all_spans(t)
    assert [k for _, _, k in base] == ["email"] and [k for _, _, k in every] == ["iban", "tel", "email"]
    assert set(base) <= set(every)
    assert pii.redact(t, every).startswith("IBAN [IBAN] ok; GB82") and "[TEL]" in pii.redact(t, every) and "q@w.er" not in pii.redact(t, every)
    assert pii.redact(None, []) is None


@pytest.mark.parametrize(
    "text,want",
    [
        ("to DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
        ("to DE89 3704 0044 0532 0130 00 I paid", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 2024", ["DE89370400440532013000"]),
        ("GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 EUR 5", ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]),
        ("NR12 DE89370400440532013000 X", ["DE89370400440532013000"]),
        ("DE89 3704 0044 0532 0130 01 BIC", []),
        ("DE89370400440532013000X", []),
    ],
)
def test_an_iban_ends_where_its_number_ends(text, want):
    assert [text[s:e] for s, e, k in pii.all_spans(text)[1] if k == "iban"] == want


def test_pii_rows(spark, docs, none):
    assert pii.find(none).count() == 0
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs)).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, r in got.items():
        spans = plain_base(text[i] or "")
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in spans) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
    assert [got[8][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1]
    red = pii.redact_column(docs)
    assert red.schema == docs.schema and red.count() == docs.count()
    row = red.where("doc_id = 8").first()
    assert row["text"] == "mail [EMAIL], card [CARD], ip [IP], call [PHONE] now" and row["n_chars"] == len(row["text"])


# packing


def check_packing(df, got, window=packing.SEQUENCE):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in df.collect())
    got = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    for r in got:
        assert r["sequence_id"] * window + r["offset"] == place and r["offset"] + r["length"] <= window and r["length"] > 0
        place += r["length"]
    assert place == sum(map(len, want))
    return want


def test_packing_round_trip(spark, docs, none):
    assert packing.pack(none).count() == 0
    got = packing.pack(docs).collect()
    want = check_packing(docs, got)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], r["text"])
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for (i, n), pieces in by.items():
        ids = np.array([*tok.encode(text[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert len(ids) == n
        copies = sum(length for _, length, _ in pieces) // n
        assert copies * n == sum(length for _, length, _ in pieces)
        cover = np.zeros(n, dtype=int)
        for s, length, crc in pieces:
            cover[s : s + length] += 1
            assert zlib.crc32(ids[s : s + length].tobytes()) == crc
        assert (cover == copies).all()
    assert want


def shares(got):
    """Tokens by source, all and by sequence."""
    total, per = {}, {}
    for r in got:
        total[r["source"]] = total.get(r["source"], 0) + r["length"]
        own = per.setdefault(r["sequence_id"], {})
        own[r["source"]] = own.get(r["source"], 0) + r["length"]
    return total, per


def test_windows_hold_the_mixture(spark):
    data = [(i, words(60, i), "a" if i % 4 else ("b" if i % 8 else "c")) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(df).collect()
    check_packing(df, got)
    total, per = shares(got)
    n = sum(total.values())
    for w, own in per.items():
        if w < max(per):
            for s in total:
                assert abs(own.get(s, 0) - packing.SEQUENCE * total[s] / n) <= 2


def test_windows_of_the_tables_hold_the_mixture(spark, sf):
    """The query's defaults and the 20 sources of the table: every full window is the mix, with at most one stretch a source."""
    big = sf.replace("sf0.001", "sf0.01")
    got = queries.op3_packing(spark, big).collect()
    total, per = shares(got)
    n = sum(total.values())
    assert len(total) == 20 and len(per) > 400
    own = {s for s, t in total.items() if t * packing.SEQUENCE >= packing.QUANTUM * n}
    full = [w for w in per if w < max(per)]
    variation = [sum(abs(per[w].get(s, 0) / packing.SEQUENCE - t / n) for s, t in total.items()) / 2 for w in full]
    small = sum(t for s, t in total.items() if s not in own) / n
    assert max(variation) <= 0.01 + small
    assert all(abs(per[w].get(s, 0) - packing.SEQUENCE * total[s] / n) <= 2 for w in full for s in own)
    # A stretch of a source ends only where the source's turn or a document does.
    last = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        key = (r["sequence_id"], r["source"])
        if r["source"] in own and key in last:
            assert last[key] == r["offset"]
        last[key] = r["offset"] + r["length"]


@pytest.mark.parametrize("seed", range(6))
def test_clock_serves_all_queues_to_the_end(seed):
    rng = np.random.default_rng(seed)
    totals = rng.integers(1, 10 ** rng.integers(2, 13), size=rng.integers(1, 60))
    totals.sort()
    rates = totals.astype(float) if seed % 2 else np.maximum(rng.integers(1, 9, size=len(totals)), totals.max() / 1e6)
    clock = packing.Clock(totals, rates, 2048)
    every = np.arange(clock.windows + 1) if clock.windows < 5000 else np.unique(np.concatenate([np.arange(2000), np.arange(clock.windows - 2000, clock.windows + 1), rng.integers(0, clock.windows, 3000)]))
    served = clock.served(every)
    assert (served[-1] == np.minimum(every * 2048, totals.sum())).all() and (served[:, 0] == 0).all()
    own = np.diff(served, axis=0)
    assert (own >= 0).all() and (np.diff(own, axis=1) >= 0).all() and (own <= totals[:, None]).all() and (own[:, -1] == totals).all()
    if seed % 2:
        assert (np.abs(own - served[-1] * (totals / totals.sum())[:, None]) <= 2).all()


def test_small_sources_are_spread_evenly(spark):
    """One large source and 2,000 small ones that share the other half: every stretch of the output is half and half."""
    data = [(i, words(40, i), f"s{i}") for i in range(2000)] + [(5000 + i, words(400, i), "big") for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(df).collect()
    check_packing(df, got)
    big = sum(r["length"] for r in got if r["source"] == "big") / sum(r["length"] for r in got)
    served = whole = 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        whole += r["length"]
        served += r["length"] * (r["source"] == "big")
        assert abs(served - big * whole) <= 2 * packing.SEQUENCE * 0.25


def test_weights_hold_until_a_source_ends(spark):
    data = [(i, words(50, i), "a" if i % 3 else None) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(df, weights={"a": 1.0, None: 3.0}).collect()
    check_packing(df, got)
    end = max(r["sequence_id"] for r in got if r["source"] is None and r["length"] > 0)
    end = min(end, sum(r["length"] for r in got if r["source"] is None) * 4 // 3 // packing.SEQUENCE)
    for w in range(end - 1):
        share = sum(r["length"] for r in got if r["sequence_id"] == w and r["source"] is None) / packing.SEQUENCE
        assert abs(share - 0.75) <= 2 * 128 / packing.SEQUENCE


def test_pieces_are_not_shreds(spark, sf):
    got = queries.op3_packing(spark, sf).collect()
    docs, windows = spark.read.parquet(f"{sf}/documents.parquet").count(), 1 + max(r["sequence_id"] for r in got)
    # Cuts are ends of documents and of the sources' turns.
    assert len(got) <= docs + windows * len({r["source"] for r in got})


def test_special_strings_and_long_runs(spark):
    texts = ["a <|endoftext|> b", "x" * 5000, " " * 3000 + "y", "\n\n\t 1234 naïve 東京"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    check_packing(df, packing.pack(df).collect())


# language


def test_language_by_held_out_rows(spark, sf):
    got = queries.op5_langid(spark, sf.replace("sf0.001", "sf0.01")).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)


def brute_counts(text):
    """Hashed 1-3-grams of letters and single blanks, one at a time."""
    runs, out = "".join(c if c.isalpha() else " " for c in text.lower()).split(), {}
    if not runs:
        return None
    p = [ord(c) for c in f" {' '.join(runs)} "]
    m = (1 << 32) - 1
    one = [q * 2654435761 & m for q in p]
    two = [(a ^ (q * 2246822519 & m)) * 3266489917 & m for a, q in zip(one, p[1:])]
    three = [(a ^ (q * 668265263 & m)) * 374761393 & m for a, q in zip(two, p[2:])]
    for h in (*one, *two, *three):
        out[h >> 20] = out.get(h >> 20, 0) + 1
    return out


def test_languages_of_the_table_against_every_centroid(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, ~held_out("doc_id", 4, 2))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op5_langid(spark, sf).collect()
    assert len(got) == len(text)
    for r in got[:80]:
        c = brute_counts(text[r["doc_id"]] or "")
        if c is None:
            assert r["lang_pred"] == "und"
            continue
        v = {k: math.log1p(n) * float(model.idf[k]) for k, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(m[k]) for k, x in v.items()) / norm for m in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert abs(cos[best] - r["cosine"]) < 1e-4
        assert model.langs[model.owner[best]] == r["lang_pred"] or sorted(cos)[-2] > cos[best] - 1e-4


def test_counts_beyond_two_bytes_are_kept(spark):
    """A hundred thousand equal letters weigh more than 65,535 of them."""
    df = spark.createDataFrame([(1, "a" * 100_000 + " bc", "x"), (2, "b c d" * 9, "y")], "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert got[1]["lang_pred"] == "x" and got[2]["lang_pred"] == "y" and got[1]["cosine"] > 1 - 1e-5 and got[2]["cosine"] > 1 - 1e-5


def test_many_languages_fit_in_the_sample(spark):
    df = spark.createDataFrame([(i, words(20, i), f"l{i % 300}") for i in range(1200)], "doc_id long, text string, lang string")
    assert len(langid.fit(df, F.lit(True), rows=600).owner) <= 900


def test_language_edges(spark, docs, none):
    assert langid.fit(none, F.lit(True)) is None and langid.predict(none, None).count() == 0
    model = langid.fit(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(got) <= docs.count() and {i for i, r in got.items() if r["lang_pred"] == "und"} == {4, 5, 6}
    assert set(r["lang_pred"] for r in got.values()) <= {"en", "fr", "de", "und"}
    assert langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0


def test_long_texts_count_like_short_ones():
    t = words(30000, 5)
    whole = langid.counts(t)
    old, langid.PIECE = langid.PIECE, 1000
    try:
        assert (langid.counts(t) == whole).all()
    finally:
        langid.PIECE = old


# near copies


def brute_join(rows, threshold=0.8):
    sets = []
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None))
    n = len(sets)
    links = [0] * n
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x is not None and y is not None and len(x & y) >= threshold * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for a in range(n):
        groups.setdefault(find(a), []).append(sets[a][0])
    low = {g: min((i for i in v if i is not None), default=None) for g, v in groups.items()}
    return sorted(((sets[a][0], low[find(a)], links[a]) for a in range(n)), key=repr)


@pytest.mark.parametrize("blocks", [(1024, 512), (3, 2)])
def test_join_against_brute_force(spark, docs, blocks, monkeypatch):
    monkeypatch.setattr(ngram_join, "SKETCH_BLOCK", blocks[0])
    monkeypatch.setattr(ngram_join, "SET_BLOCK", blocks[1])
    rnd = random.Random(7)
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for g in range(6):
        toks = words(70, 100 + g).split()
        for k in range(7):
            t = list(toks)
            for _ in range(rnd.choice([0, 1, 1, 2, 6])):
                t[rnd.randrange(70)] = f"z{k}"
            data.append((1000 + 10 * g + k, " ".join(t)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(df).collect()), key=repr)
    assert got == brute_join(data)


def test_join_edges(spark, none):
    assert ngram_join.join(none).count() == 0 and ngram_join.deduplicate(none).count() == 0
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "One, TWO!"), (5, "two one"), (None, "q")], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(df).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 1), 4: (3, 1), 5: (5, 0), None: (None, 0)}


def test_one_of_each_group_stays(spark, docs):
    got = ngram_join.deduplicate(docs)
    assert got.schema == docs.schema
    ids = sorted([r["doc_id"] for r in got.collect()], key=repr)
    assert ids == sorted([1, 4, 5, 6, None, 7, 8, 9, 10], key=repr)  # 2 twice, 3, and one of the rows without an id are gone


def test_shingles_do_not_depend_on_segments(monkeypatch):
    t = words(3000, 12) + " " + "x" * 5000 + " end"
    whole = ngram_join.shingles(t)
    plain = {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    assert len(whole) == len(plain) and (np.diff(whole.astype(object)) > 0).all()
    monkeypatch.setattr(ngram_join, "SEGMENT", 700)
    assert (ngram_join.shingles(t) == whole).all()


def test_pruning_keeps_similar_pairs():
    least = ngram_join.least_matches(0.8)
    assert all(m <= 0.8 * n for m, n in zip(least, range(20, 101, 20), strict=True)) and least[-1] > 50
    rnd = np.random.default_rng(1)
    lost = 0
    for _ in range(4000):
        eq = rnd.random(100) < 0.82
        lost += any(eq[:n].sum() < m for m, n in zip(least, range(20, 101, 20), strict=True))
    assert lost <= 4


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}, 200: 200, 201: 200}


# toxicity


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


def test_automaton_against_edit_distance():
    terms = ["stupid", "disgusting", "worthless", "idiot", "scum"]
    lex = toxicity.Lexicon([(t, False, 1.0) for t in terms] + [("fooz", True, 2.0)])
    rnd = random.Random(1)
    for _ in range(4000):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            i, op = rnd.randrange(len(w) + 1), rnd.random()
            if op < 0.33:
                w.insert(i, rnd.choice("abcdeiou"))
            elif i < len(w):
                w[i : i + 1] = [] if op < 0.66 else [rnd.choice("abcde")]
        w = "".join(w)
        if not w:
            continue
        assert (lex.hit(w) is not None) == any(edit(w, t) <= (0 if len(t) < 5 else 1 if len(t) < 10 else 2) for t in terms), w
    assert lex.hit("foozle") == (5, 1) and lex.hit("afooz") is None and lex.hit("scumm") is None


def brute_hit(lex, word):
    """The kind of hit that a word is by comparing it with every term."""
    starts = [len(t) for t, stem, _ in lex.terms if stem and word.startswith(t)]
    if any(word == t for t, stem, _ in lex.terms if not stem):
        return 0
    if starts:
        return 1
    for t, stem, _ in lex.terms:
        if stem and len(t) >= toxicity.FUZZY_STEM and min(edit(word[:k], t) for k in range(len(t) + 2)) <= 1:
            return 2
        if not stem and len(t) >= 5 and edit(word, t) <= (1 if len(t) < 10 else 2):
            return 2
    return None


def test_hits_against_every_term():
    rnd = random.Random(11)
    terms = [("bravado", False, 1.0), ("granul", True, 2.0), ("mendacious", False, 1.5), ("tox", True, 1.0), ("plonk", False, 1.0), ("x" * 90, False, 1.0)]
    lex = toxicity.Lexicon(terms)
    for _ in range(6000):
        w = list(rnd.choice(terms)[0] + rnd.choice(["", "", "arity", "s"]))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "n", "x"])
        w = "".join(w) or "q"
        got = lex.hit(w)
        assert (None if got is None else got[1]) == brute_hit(lex, w), w
    assert lex.hit("granolarity")[1] == 2 and lex.hit("ganularity")[1] == 2 and lex.hit("x" * 89)[1] == 2 and lex.hit("x" * 40) is None


def test_scores_of_the_tables_against_every_term(spark, sf):
    """op1 on its table: each distinct word compared with every term, and the features summed from these hits."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), toxicity.not_held_out())
    assert isinstance(model, toxicity.Model)
    kinds = {}
    got = {r["doc_id"]: r["score"] for r in queries.op1_toxicity(spark, sf).collect()}
    for r in docs.collect():
        low = (r["text"] or "").lower()
        found = list(re.finditer(r"\w+", low))
        for w in {m[0] for m in found} - kinds.keys():
            kinds[w] = brute_hit(model.lexicon, w)
        hit = {w: [] for w in {m[0] for m in found} if kinds[w] is not None}
        for m in found:
            if m[0] in hit:
                hit[m[0]].append(toxicity.context_weight(low, m.start(), m.end()))
        distinct, total, odds = [0.0] * 3, [0.0] * 3, {}
        for w, weights in hit.items():
            k = kinds[w]
            distinct[k] += sum(weights) / len(weights)
            total[k] += sum(weights)
            # Words that share a term count once, with the largest mean weight.
            term = model.lexicon.hit(w)[0]
            odds.setdefault((term, k == 2), []).append(model.lexicon.odds[term] * sum(weights) / len(weights) * (0.5 if k == 2 else 1))
        share = sum(total) / max(1, len(found))
        x = [*(math.log1p(v) for v in distinct), *(math.log1p(v) for v in total), sum(map(max, odds.values())) / 4, math.sqrt(100 * share)]
        want = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True)) + model.bias))))
        assert abs(got[r["doc_id"]] - want) < 1e-9, r["doc_id"]


def test_held_out_labels_change_no_score(spark, sf):
    """Neither the sample's shares nor its weights know them, at a bound that both kinds of labels exceed."""
    big = sf.replace("sf0.001", "sf0.01")
    docs, marks = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    out = held_out("doc_id", 5, 0)
    flipped = marks.withColumn("toxic", F.when(out, F.lit(1)).otherwise(F.col("toxic")))
    gone = marks.where(~out)
    assert flipped.where("toxic = 1").count() > marks.where("toxic = 1").count() + 20
    models = [toxicity.fit(docs, m, toxicity.not_held_out(), rows=150) for m in (marks, flipped, gone)]
    assert all(isinstance(m, toxicity.Model) for m in models)
    assert len({m.lexicon.terms for m in models}) == 1 and len({(m.bias, *m.weights.tolist()) for m in models}) == 1
    # Labels of one kind among the training rows are of one kind, whatever the others are.
    one = marks.withColumn("toxic", out.cast("int"))
    assert toxicity.fit(docs, one, toxicity.not_held_out()) == 0.0


@pytest.mark.parametrize("kind", [0, 1])
def test_labels_of_one_kind_drop_nothing(spark, docs, kind):
    marks = spark.createDataFrame([(1, kind), (2, kind)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.lit(True))
    assert model == float(kind) and toxicity.keep_clean(docs, model).count() == docs.count()


def test_quotation_counts_less_than_abuse():
    lex = toxicity.Lexicon([("idiot", False, 3.0)])
    plain = toxicity.features("what an idiot he is", lex)
    for t in ("he wrote “what an idiot” there", 'the sign read "total idiot" today', "she called him an idiot", "he said idiot"):
        assert toxicity.features(t, lex)[0] < plain[0], t
    assert toxicity.features("you idiot", lex)[0] > plain[0]
    assert toxicity.features("what an idjot he is", lex)[2] > 0 and toxicity.features("", lex) == [0.0] * toxicity.FEATURES


def test_toxicity_on_planted_rows(spark):
    rnd = random.Random(3)
    data, labels = [], []
    for i in range(500):
        w = words(60, i).split()
        bad = i % 5 == 0
        if bad:
            for t in ("vilest", "grubbing"):
                w[rnd.randrange(60)] = t
                w[rnd.randrange(60)] = t
        data.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(bad)))
    data += [(900, None), (901, ""), (902, "the vilest grubbinng talk, vilest talk"), (None, "vilest")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, ~held_out("doc_id", 5, 0))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(data) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(400, 500))
    assert got[900] == got[901] < 0.5 <= got[902]
    kept = toxicity.keep_clean(docs, model)
    odd = toxicity.keep_clean(docs.withColumn("a.b", F.lit(1)), model)
    assert odd.columns == [*docs.columns, "a.b"] and odd.count() == kept.count()
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {900, 901} and kept.count() <= len(data) - 100


def test_toxicity_without_labels(spark, docs, none):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, marks, F.lit(True)) == 0.0
    assert toxicity.score(none, 0.0).count() == 0 and toxicity.score(docs, 0.25).where("score <> 0.25").count() == 0


def test_regression_weights_are_sane():
    rnd = np.random.default_rng(0)
    x = np.abs(rnd.normal(size=(400, 3)))
    y = (x[:, 0] * 4 - 3 + rnd.normal(size=400) * 0.3 > 0).astype(float)
    w, b = toxicity._logistic(x, y, np.ones(400))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert (w >= 0).all() and ((p > 0.5) == (y > 0.5)).mean() > 0.95 and math.isfinite(b)


def test_document_queries_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in queries.op9_ngram_join(spark, sf).collect()), key=repr)
    assert got == brute_join(data)
    check_packing(docs, queries.op3_packing(spark, sf).collect())
    text = dict(data)
    for r in queries.op2_pii(spark, sf).collect():
        spans = plain_base(text[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for s, e, k in spans) <= set(r["spans"].split(",")) or not spans
    scores = queries.op1_toxicity(spark, sf).collect()
    assert len(scores) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scores)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scores)


def test_toxicity_by_held_out_labels(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [(r["score"], toxic[r["doc_id"]]) for r in queries.op1_toxicity(spark, big).collect() if r["held_out"] and r["doc_id"] in toxic]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.93 and sum(s >= 0.5 for s in neg) / len(neg) < 0.02
