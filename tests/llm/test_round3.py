"""Clustering, token files and conversation repair against plain loops, with nulls, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from frameline.llm import clusters, common, media, mixing, repair, sharding, tokenfile
from frameline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


# ---- clustering


def lloyd_loop(rows, size, k, rounds, seed, scale):
    import math

    kept = []
    for i, v in rows:
        if v is None or len(v) != size or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(scale * x) for x in v]))
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for c in set(found):
            mine = [v for (_, v), n in zip(kept, found) if n == c]
            centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *near(v)) for i, v in kept]
    return sorted((str(i), n, d, sum(x for _, x, m in out if m == n), sum(x for _, x, _ in out), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, cluster int")


def test_lloyd_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, 0.25, 2.0]) + rng.random() for _ in range(4)]) for i in range(200)]
    rows += rows[:20] + [(None, [0.5] * 4), (None, [0.25] * 4), (7, [9.0] * 4)]
    odd = [(300, None), (301, [1.0] * 3), (302, [1.0, None, 1.0, 1.0]), (303, [1.0, float("nan"), 1.0, 1.0]), (304, [1.0, float("-inf"), 1.0, 1.0]), (305, [])]
    got = clusters.cluster(vectors(spark, rows + odd), size=4, k=9, rounds=3)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got.collect()) == lloyd_loop(rows, 4, 9, 3, 2, 256)


def test_lloyd_of_little_and_of_equal_vectors(spark):
    assert clusters.cluster(vectors(spark, []), size=4).count() == 0
    got = clusters.cluster(vectors(spark, [(i, [1.0] * 4) for i in range(6)]), size=4, k=3).collect()
    assert len(got) == 6 and {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}  # ties go to the smaller number, empty centroids stay
    got = clusters.cluster(vectors(spark, [(1, [2.0] * 4), (2, [3e38] * 4)]), size=4, k=3).collect()
    assert [(r["vec_id"], r["distance"]) for r in got] == [(1, 0)]  # what would fit no long takes no part
    far = clusters.cluster(vectors(spark, [(i, [5e5 * (-1) ** i] * 4) for i in range(5)]), size=4, k=1, rounds=1).collect()
    assert len({r["inertia"] for r in far}) == 1 and far[0]["inertia"] == sum(r["distance"] for r in far)
    with pytest.raises(ValueError):
        clusters.cluster(vectors(spark, []), k=0)


def test_lloyd_query_and_sql(spark):
    assert not oracle.compare(QUERIES["op11_lloyd"](spark, SF), ORACLE_SQL["op11_lloyd"], oracle.duck(SF))


# ---- conversation repair

SPEAKS, NAMES = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def repair_loop(rows, damage=True):
    """Row by row over the four states, without heuristic or queue."""
    out = []
    for c, turn, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 19
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    known = [t for t, _, _ in out if t is not None]
    seen, faults = set(), ""
    for _, role, text in out:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        faults += "b" if not letters else "d" if (role, text) in seen else "n" if letters[-1] in ".!?" else "t"
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))

    def with_inserts(best):
        for _ in range(3):
            for q, (cost, audit, lines) in list(best.items()):
                new = (cost + 3, audit + "I", lines + [(NAMES[SPEAKS[q]], "")])
                if SPEAKS[q] not in best or new[:2] < best[SPEAKS[q]][:2]:
                    best[SPEAKS[q]] = new
        return best

    best = with_inserts({0: (0, "", [])})
    for (_, role, text), fault in zip(out, faults):
        to = {}
        for q, (cost, audit, lines) in best.items():
            ways = [(q, cost + 4, "D", [])]
            if fault in "nt":
                more = 3 * (fault == "t")
                ways.append((SPEAKS[q], cost + 3 + more, "R", [(NAMES[SPEAKS[q]], text)]))
                if (q, role[:1]) in KEEPS:
                    ways.append((KEEPS[q, role[:1]], cost + more, "K", [(role, text)]))
            for s, price, letter, line in ways:
                if s not in to or (price, audit + letter) < to[s][:2]:
                    to[s] = (price, audit + letter, lines + line)
        best = with_inserts(to)
    cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest), lines


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, part int")


def some_talks(seed=1):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", "", " \n", None, "So it is!", "It is.\x0b", "word " * 400, "é."]
    rows = []
    for c in [None, *range(40)]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, None, t // 2, -t]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    rows += rows[:25]
    rows += [(99, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"{rng.choice(texts)}{t % 50}.") for t in range(400)]
    return rows


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 3, "range_bytes": 2000}])
def test_repair_against_a_loop(spark, sizes):
    rows = some_talks()
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(repair.damaged(talks(spark, rows)), **sizes).collect()}
    assert got == {c: repair_loop(rs)[0] for c, rs in by_conversation(rows).items()}


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 4, "range_bytes": 3000}])
def test_repaired_turns(spark, sizes):
    rows = some_talks(2)
    plain = repair.with_copies(talks(spark, rows), "conv_id", "turn", "role", "text")
    got = {}
    for r in repair.repaired_turns(plain, **sizes).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append(r)
    want = {c: repair_loop(rs, damage=False)[1] for c, rs in by_conversation(rows).items()}
    assert {c: [(r["role"], r["text"]) for r in rs] for c, rs in got.items()} == {c: lines for c, lines in want.items() if lines}
    assert all([r["place"] for r in rs] == list(range(len(rs))) for rs in got.values())


def test_repair_of_nothing(spark):
    assert repair.repair(repair.damaged(talks(spark, []))).count() == 0
    dropped = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = repair.repair(repair.damaged(talks(spark, [(*dropped, "user", "Yes.")]))).collect()
    assert [tuple(r) for r in got] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_query_and_sql(spark):
    assert not oracle.compare(QUERIES["op13_repair"](spark, SF), ORACLE_SQL["op13_repair"], oracle.duck(SF))


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_repair"](spark, SF).collect()}
    assert got == {c: repair_loop(rs)[0] for c, rs in by_conversation(rows).items()}


# ---- defects of earlier rounds


def test_rates_of_skewed_cells_end_with_the_best_point(spark):
    cells = spark.createDataFrame([(10**12, 0.999999, 1e-6, 1e-9), (3, 0.1, 0.1, 0.8)], "tokens bigint, p0 double, p1 double, p2 double")
    push = mixing.fit_rates(cells, ["clean", "poor", "toxic"], mixing.TARGETS, 1e12 + 3, rounds=60)
    assert len(push) == 3 and all(map(math.isfinite, push))


def test_a_small_fraction_draws_rows(spark):
    n = 2_000_000
    drawn = spark.range(n).where(common.hash_below(F.col("id"), 4e-6 / 10)).count()  # under a millionth
    assert common.hash_below(F.col("id"), 1e-12) is not None and drawn <= 8
    assert 60 <= spark.range(n).where(common.hash_below(F.col("id"), 5e-5)).count() <= 140
    assert spark.range(100).where(common.hash_below(F.col("id"), 1.0)).count() == 100
    fraction = "shiftrightunsigned(xxhash64(7, id), 1) < %d" % int(4e-7 * (1 << 63))
    assert spark.range(20_000_000).where(fraction).count() == spark.range(20_000_000).where(common.hash_below(F.col("id"), 4e-7)).count() > 0


# ---- token files


def test_blocks_come_back():
    rng = np.random.default_rng(4)
    for n, top in ((1, 5), (1000, 50_257), (1024, 1), (64, 1 << 32)):
        for percentile in (1.0, 50.0, 98.0, 100.0):
            rows = (rng.pareto(1, (7, n)) * 3 % top).astype(np.uint32)
            rows[3] = 9 % top
            packed = tokenfile.pack(rows, percentile)
            assert (tokenfile.unpack([memoryview(b) for b in packed]) == rows.ravel()).all()
    few = np.zeros((1, 100), np.uint32)
    few[0, 50] = 1 << 31
    assert len(tokenfile.pack(few, 98.0)[0]) == tokenfile.HEAD.size + 6  # one exception, no bits for the rest


class Memory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_a_file_is_read_by_ranges():
    rng = random.Random(6)
    docs = [(None if i < 2 else i * 3, np.array([rng.randrange(60_000) for _ in range(rng.choice([0, 1, 5, 700]))], np.uint32)) for i in range(300)]
    out = io.BytesIO()
    out.close = lambda: None
    w = tokenfile.Writer(out, block=64)
    for i, ids in docs:
        w.add(i, ids)
    assert w.close() == len(out.getvalue())
    r = tokenfile.Reader(Memory(out.getvalue()))
    got = [x for a in range(0, r.n_ids + 1, 5000) for x in r.documents(a, a + 5000, at_once=1000)]
    assert [(i, ids.tolist()) for i, _, ids in got] == [(i, ids.tolist()) for i, ids in docs]
    assert [at for _, at, _ in got] == np.cumsum([0] + [len(d) for _, d in docs])[:-1].tolist()
    for broken in (b"", out.getvalue()[:-1], out.getvalue()[:2000] + out.getvalue()[-44:]):
        with pytest.raises(ValueError):
            tokenfile.Reader(Memory(broken))


ODD = [None, "", " ", "  two  spaces ", "a b c d", "tab\t and\nline \n end", " lead", "trail ", "x<|endoftext|>y <|endoftext|> z", "it's we'll", "é\x1c \x1df", "東京 12,345 🎉🎉", "w" * 3000, "same words here", "same words here"]


def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_against_the_library():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(tokenizer_file()), tokenfile.Encoder(open(tokenizer_file(), encoding="utf-8").read())
    rng = random.Random(8)
    signs = ["a", "B", " ", " ", " ", "\n", "\t", "'s", "é", "1", ".", " ", "<|endoftext|>", "\x1d", "Ġ", "\u0085"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(3000)]
    assert [np.frombuffer(b, "<u4").tolist() for b in mine.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    words = tokenfile.Encoder(open(tokenizer_file().replace("byte_bpe_50k", "word_bpe_49k"), encoding="utf-8").read())
    assert not words.by_words and words.encode(["one Two"]) == words._ids(["one Two"])


@pytest.mark.parametrize("sizes", [{}, {"file_bytes": 900, "block": 16}])
def test_token_files_against_the_library(spark, sizes):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(None, "no id", 1), (5, "again", 2), (5, "again", 2), (-3, "first", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(3)
    folder = common.fresh_path(spark, "tokens")
    manifest = tokenfile.write(df, folder, open(tokenizer_file(), encoding="utf-8").read(), 2, **sizes)
    got = sorted(tokenfile.read(manifest, folder, read_ids=50).collect(), key=lambda r: (r["start"], r["n_tokens"]))
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted((str(i), ids(t)) for i, t, _ in rows)
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys) and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    crc = {(r["start"], r["ids_crc32"]) for r in tokenfile.checksums(manifest, folder).collect()}
    assert crc == {(r["start"], zlib.crc32(r["ids"])) for r in got}
    assert manifest.count() == (1 if not sizes else manifest.count()) and manifest.agg(F.sum("n_docs")).first()[0] == len(rows)


def test_token_files_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    folder = common.fresh_path(spark, "tokens")
    manifest = tokenfile.write(df, folder, open(tokenizer_file(), encoding="utf-8").read(), 2)
    assert manifest.count() == 0 and tokenfile.checksums(manifest, folder).count() == 0


def test_token_file_query(spark):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(tokenizer_file()), 0
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_tokenfile"](spark, SF).collect()}
    for i, t in sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert got.pop(i) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


# ---- tests owed to earlier operators


def test_interleaving_against_a_loop(spark):
    """The definition on one machine: seeded ranks by cell and hash, fractional ranks with a phase, cuts."""
    rng, cells, shards = random.Random(21), 16, 7
    rows = [(None if i % 50 == 0 else i, None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"s{rng.randrange(40)}", f"t{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    mix = F.xxhash64(F.lit(42), "doc_id", "doc_id", "source", "text")
    phase = (F.pmod(F.xxhash64(F.lit(42), F.lit("phase"), name), F.lit(1 << 20)) + 0.5) / (1 << 20)
    given = df.select("doc_id", "text", name.alias("name"), mix.alias("mix"), phase.alias("phase")).collect()
    strata = {}
    for r in given:
        strata.setdefault(r["name"], []).append(r)
    placed = []
    for name, rs in strata.items():
        rs.sort(key=lambda r: (((r["mix"] % (1 << 64)) >> 40) % cells, r["mix"]))
        placed += [((k - r["phase"]) / len(rs), name, r["mix"], r["text"]) for k, r in enumerate(rs, 1)]
    want = {}
    for place, (*_, text) in enumerate(sorted(placed)):
        shard = place * shards // len(rows)
        want[text] = (shard, place - -(-shard * len(rows) // shards))
    got = {r["text"]: (r["shard"], r["slot"]) for r in sharding.interleave(df, "doc_id", "source", shards, cells=cells).collect()}
    assert got == want


def test_media_features_have_their_values(spark):
    texts = [None, "", "abc", "é" * 300, "x" * 192, "0123456789" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = common.fresh_path(spark, "media")
    got = {r["doc_id"]: r for r in media.features(media.metadata(media.store(df, folder), folder), folder).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw += b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        bands = [sum(b >> 4 == k for b in raw) * 1000 // len(raw) for k in range(16)]
        assert got[i]["feature"] == ",".join(map(str, bands)) and got[i]["payload_sha256"] == hashlib.sha256(raw).hexdigest()
        assert (got[i]["width"], got[i]["height"], got[i]["bit_depth"]) == (192, len(raw) // 192, 8)
