"""The training-data operators on the given tables: against SQL, brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import pytest
from conftest import DATA

from tesela.llm import audio, fingerprints, html_extract, jaccard_join, language, packing, queries, sharding, warc
from tesela.llm.shingles import shingle_sets

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, duck, same):
    same(queries.QUERIES[name](spark, SF), duck(queries.ORACLES[name]))


def covered(rows, ids):
    """Pieces that hold every id once, with their checksums, in sequences without gaps; the padding."""
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        by[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(ids)
    for k, parts in by.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k])
    pad = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert sorted(sequences) == list(range(len(sequences)))
    return pad


def token_ids(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return {k: np.array([*tokenizer.encode(v or "", add_special_tokens=False).ids, 1], "<u4") for k, v in docs.items()}


def test_packing_holds_every_token_once(spark, docs):
    ids = token_ids(docs)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(df)
    assert covered(packed.collect(), ids) == 0
    sequences = {r["sequence_id"]: r["ids"] for r in packing.sequences(df, packed).collect()}
    assert sorted(x for s in sequences.values() for x in s) == sorted(x for v in ids.values() for x in v.tolist())


def test_shards_hold_every_row_once(spark, docs):
    rows = sharding.op3_external_shuffle(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = collections.defaultdict(list)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), None)
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.op3_external_shuffle(spark, SF).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def words_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    """Smallest key of every document's component, all pairs compared."""
    sets, parent = {k: words_set(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join_equals_all_pairs(spark, docs, small, monkeypatch):
    if small:  # pieces, cells, blocks and leaves of a few documents, nearly all shared shingles go last
        for name, value in (("REGION_ROWS", 2), ("BLOCK_ROWS", 2), ("LEAF", 2), ("COMMON", 2), ("SAMPLE", 1), ("FREQUENT", 3), ("BUCKET_TOKENS", 500)):
            monkeypatch.setattr(jaccard_join, name, value)
    base = [f"w{i}" for i in range(120)]
    rng = np.random.default_rng(3)
    texts = {k: v for k, v in docs.items() if k < 120}
    for j in range(60):  # a dense group: copies of one text with a few words changed, and chains of them
        w = base.copy()
        for at in rng.choice(120, rng.integers(0, 8), replace=False):
            w[at] = f"x{rng.integers(5)}"
        texts[1000 + j] = " ".join(w[: 120 - int(rng.integers(0, 30))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, sizes = components(texts)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard_join.near_duplicate_classes(df).collect()}
    assert got == {k: (want[k], sizes[k]) for k in texts}
    assert len(set(want.values())) < len(texts)
    left = {r["doc_id"] for r in jaccard_join.near_duplicates(df).collect()}
    assert left == set(want.values())


@pytest.mark.parametrize("block", [12, 500])
def test_searches_of_a_large_region_are_split(spark, block, monkeypatch):
    """One region of near copies, with cells and without: no task is met by more than a few slices' worth of documents."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard_join, "SEARCH_ROWS", 8)
    found, most = jaccard_join._searched, 8 * 4

    def searched(words, similarity):
        inner = found(words, similarity)

        def run(batches):
            held = list(batches)
            met = collections.Counter((p, part) for b in held for p, part, role in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if role == 1)
            assert max(met.values(), default=0) <= most, met.most_common(3)
            yield from inner(iter(held))

        return run

    monkeypatch.setattr(jaccard_join, "_searched", searched)
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(150)], {}
    for k in range(240):
        w = base.copy()
        for at in rng.choice(150, rng.integers(0, 6), replace=False):
            w[at] = f"x{rng.integers(4)}"
        texts[k] = " ".join(w)
    want, sizes = components(texts)
    rows = jaccard_join.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in rows} == {k: (want[k], sizes[k]) for k in texts}


def test_bytes_and_rows_of_elections_do_not_grow_with_buckets(spark, docs, monkeypatch):
    """Over many buckets a pair of document and pivot is one row, and a rare prefix shingle takes 12 bytes and a row's own few."""
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", 200)
    texts = {k: v for k, v in docs.items() if k < 60}
    for j in range(40):  # pairs of near copies, which share shingles in nearly all buckets
        w = [f"w{j}x{i}" for i in range(400)]
        texts |= {1000 + 2 * j: " ".join(w), 1001 + 2 * j: " ".join(w[:-9])}
    df, tables, votes = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), {}, []
    kept, arrow = jaccard_join.materialize, type(df).mapInArrow

    def materialize(table, label):
        tables[label] = made = kept(table, label)
        if label == "jaccard-prefixes":
            tables[label] = [(len(r["tokens"]), len(r["keys"]) + len(r["sizes"])) for r in made.filter("bucket is not null").collect()]
        if label == "jaccard-seen":
            votes.extend((r["x"], r["p"]) for r in pairs[0].collect())
        return made

    pairs = []

    def map_in_arrow(self, run, schema, *more, **named):
        out = arrow(self, run, schema, *more, **named)
        if schema == "x long, p long, votes long":
            pairs.append(out)
        return out

    monkeypatch.setattr(jaccard_join, "materialize", materialize)
    monkeypatch.setattr(type(df), "mapInArrow", map_in_arrow)
    want, _ = components(texts)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicate_classes(df).collect()} == want
    assert len(votes) == len(set(votes)) > 40
    rows = tables["jaccard-prefixes"]
    assert len(rows) >= 20
    assert sum(rest for _, rest in rows) <= sum(tokens // 8 * 4 + 16 for tokens, _ in rows)
    assert "jaccard-first" not in tables


def test_packed_integers_are_whole():
    for x in ([0], [-(2**63), 2**63 - 1], [7, 7, 262], [5, 5 + 2**16], [-3, 2**32 - 3], [2**62, 2**62 + 255]):
        data = jaccard_join.pack(np.array(x, np.int64))
        assert jaccard_join.unpack(data, len(x)).tolist() == x
    assert len(jaccard_join.pack(np.arange(10**12, 10**12 + 200))) == 208


def test_elections_lose_no_link():
    """Two that link keep a pivot in common, whatever votes their smallest pivots lose."""
    rng = np.random.default_rng(11)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < rng.uniform(0.85, 1)], rng.integers(0, 2**63, int(rng.integers(0, 25))).astype(np.uint64)])) for _ in range(60)]
    prefixes = [s[: jaccard_join.prefix_length(len(s))] for s in sets]
    import pyarrow as pa

    columns = [np.concatenate(prefixes), np.repeat(np.arange(len(sets)), [len(x) for x in prefixes]), np.repeat([len(s) for s in sets], [len(x) for x in prefixes]).astype(np.int32)]
    batch = pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["tokens", "keys", "sizes"])
    votes = collections.defaultdict(dict)
    for out in jaccard_join._elected(80)(iter([batch])):
        for x, p, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            votes[x][p] = n
    kept = {}
    for x, mine in votes.items():
        need, lost, left = jaccard_join.needed(len(sets[x])), 0, {x}
        for p, n in sorted(mine.items(), key=lambda v: (v[1], v[0])):
            if p != x:
                lost += n
                left |= {p} if lost > (need - 1) // 2 else set()
        kept[x] = left if sum(mine.values()) >= need else set()
    pairs = 0
    for a in range(len(sets)):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                pairs += 1
                assert kept[a] & kept[b]
    assert pairs > 50


def test_cells_find_what_all_pairs_find():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
    sets = []
    for _ in range(150):
        keep = base[rng.random(len(base)) < rng.uniform(0.7, 1)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 15))).astype(np.uint64)])))
    cells = jaccard_join.Cells(sets, leaf=8)
    assert cells.cells
    for s in sets:
        want = [i for i, z in enumerate(sets) if 100 * (n := len(np.intersect1d(s, z))) >= 80 * (len(s) + len(z) - n)]
        assert sorted(cells.near(s)) == want


def test_html_text_of_all_pages(spark):
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>)", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split(r"</?p>|</?h1>", body)]
        assert html_extract.main_text(r["html"]) == "\n".join(p for p in parts if p)


def test_fingerprints_follow_the_next_document(spark, docs):
    rows = {r["doc_id"]: r for r in fingerprints.op7_fingerprints(spark, SF).collect()}
    keys = sorted(docs, reverse=True)
    errors = []
    for i, k in enumerate(keys):
        a, b = docs[k], docs[keys[(i + 1) % len(keys)]]
        n = len(a) // 3
        edited = a[: len(a) - n] + b[:n]
        assert rows[k]["n_chars"] == len(a) and rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, got in ((edited, rows[k]["near_edited"]), (b, rows[k]["near_next"])):
            x, y = words_set(a), words_set(other)
            errors.append(got - (len(x & y) / len(x | y) if x | y else 1.0))
    assert np.sqrt(np.mean(np.square(errors))) < 0.03


def test_sketches():
    a, b = shingle_sets([b"one two three four five six seven", b"eight nine ten eleven twelve thirteen"])
    assert fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(a)) == 1.0
    assert fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b)) < 0.1
    s = fingerprints.sketch(a)
    assert (fingerprints.unpack(fingerprints.pack(s)) == s).all()


def test_warc_round_trip_and_look_up(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    twice = pages.selectExpr("page_id + 1000 as page_id", "url", "html").filter("page_id < 1010")
    both = pages.select("page_id", "url", "html").unionAll(twice)
    archive = warc.write_archive(both)
    given, back = both.collect(), {r["page"]: r for r in warc.look_up(archive, both).collect()}
    first = {}
    for r in sorted(given, key=lambda r: r["page_id"]):
        first.setdefault(r["html"], r["page_id"])
    assert set(back) == {r["page_id"] for r in given}
    for r in given:
        got, data = back[r["page_id"]], r["html"].encode()
        assert got["payload_bytes"] == len(data) and got["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if first[r["html"]] == r["page_id"]:
            assert got["type"] == "response" and got["refers_to"] is None and bytes(got["payload"]) == data
        else:
            assert got["type"] == "revisit" and got["refers_to"] == first[r["html"]] and got["payload"] is None
    look = warc.Lookup(archive)
    by_key = collections.defaultdict(set)
    for r in given:
        by_key[warc.url_key(r["url"])].add(r["page_id"])
    for r in given:
        assert {e["page"] for e in look.find(r["url"])} == by_key[warc.url_key(r["url"])]
    few = both.filter("page_id % 7 = 0").select("url")  # look-ups of some alone read the records of these alone
    keys = {warc.url_key(r["url"]) for r in few.collect()}
    assert sorted(r["page"] for r in warc.look_up(archive, few).collect()) == sorted(k for key in keys for k in by_key[key])
    assert look.find("http://nowhere.example/") == [] and look.fetch(given[0]["url"])


def test_warc_query(spark):
    """The registered query, against the payloads of all pages."""
    rows = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for k in sorted(rows):
        first.setdefault(rows[k], k)
    got = {r["page_id"]: r for r in warc.op8_warc(spark, SF).collect()}
    assert set(got) == set(rows)
    for k, data in rows.items():
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first[data] == k else "revisit", None if first[data] == k else first[data])
        assert (got[k]["payload_bytes"], got[k]["payload_digest"], got[k]["record_type"], got[k]["refers_to"]) == want


def test_url_keys():
    assert warc.url_key("http://www.A.example.com/b?c=1") == "com,example,a)/b?c=1"
    assert warc.url_key("https://a.org:8080") == "org,a:8080)/" and warc.url_key(None) == "-"


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    held = [r for r in language.op9_language(spark, f"{DATA}/sf0.01").collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_mixture():
    counts = np.zeros((language.GRAMS, 2))
    texts = {"aa": "the quick brown fox jumps over the lazy dog and runs away " * 4, "bb": "der schnelle braune fuchs springt ueber den faulen hund " * 4}
    for i, t in enumerate(texts.values()):
        _, gram, n = language._counts([t])
        counts[gram, i] += n
    model = language.Model(list(texts), counts)
    (one, score, langs, _), (_, _, both, shares) = model.predict([texts["aa"], texts["aa"] + texts["bb"]])
    assert one == "aa" and score > 0.9 and langs == ["aa"]
    assert sorted(both) == ["aa", "bb"] and abs(shares[0] - 0.5) < 0.15


def test_audio_finds_shifted_and_noisy_copies(spark):
    rng = np.random.default_rng(7)
    tune = lambda: audio.sonify(rng.normal(size=64).tolist())
    a, others = tune(), [tune() for _ in range(5)]
    start = 20 * audio.HOP
    copy = a[start:] + rng.normal(scale=0.02, size=len(a) - start)
    pcm = lambda x: (x / 2 * 32767).astype("<i2").tobytes()
    rows = [(1, pcm(a)), (2, pcm(copy)), (3, pcm(a)), (4, None), *[(10 + i, pcm(o)) for i, o in enumerate(others)]]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, sound binary"), "id", "sound").cache()
    got = {r["key"]: bytes(r["fingerprint"]) for r in prints.collect()}
    assert got[1] == got[3] and got[4] == b"" and got[1] != got[2]
    found = {(r["query"], r["key"]): r for r in audio.search(prints.filter("key = 1"), prints.filter("key <> 3")).collect()}
    assert set(found) == {(1, 2)} and found[1, 2]["offset"] == -20 and found[1, 2]["bit_error"] < 0.2


def test_audio_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    near = [audio.fingerprint(audio.sonify((base + rng.normal(scale=0.1, size=64)).tolist())) for _ in range(40)]
    index = audio.Index(near)
    hits = sum(q != j for j, p in enumerate(near) for q, *_ in index.align(p))
    # against brute force over all offsets of all pairs
    def close(x, y):
        best = 1.0
        for shift in range(-len(x) + audio.OVERLAP, len(x) - audio.OVERLAP + 1):
            a, b = max(0, -shift), min(len(x), len(y) - shift)
            best = min(best, np.bitwise_count(x[a:b] ^ y[a + shift : b + shift]).sum() / (32 * (b - a)))
        return best <= audio.BIT_ERROR

    want = sum(close(near[i], near[j]) for i in range(40) for j in range(40) if i != j)
    assert want > 100 and hits / want >= 0.9


def test_pipeline_stage_by_stage(spark, duck):
    """Every stage on its predecessor's rows, against brute force."""
    import corpus_pipeline as P
    from tesela.llm.common import materialize

    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mix_sources", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        seen.append(docs)
    raw, known, lines, unique, mixed = ([r.asDict() for r in d.collect()] for d in seen)
    assert sorted(r["doc_id"] for r in known) == sorted(r["doc_id"] for r in raw if any(c.isalpha() for c in r["text"] or ""))
    names, found = duck(queries.ORACLES["op2_line_dedup"])
    at = {c: i for i, c in enumerate(names)}
    want = {r[at["doc_id"]]: r[at["text"]] for r in found if r[at["removed_lines"]] == 0 or (r[at["text"]] or "").strip(" \t\n\v\f\r")}
    if len(known) == len(raw):
        assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    comps, _ = components({r["doc_id"]: r["text"] for r in lines})
    assert {r["doc_id"] for r in unique} == set(comps.values())
    sizes = collections.Counter()
    for r in unique:
        sizes[r["source"]] += len(r["text"].split())
    taken = collections.Counter()
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.01)
    assert all(taken[s] <= 2 * n for s, n in sizes.items())
    packed = P.pack(spark, docs, SF).collect()
    ids = token_ids(dict(enumerate(r["text"] for r in mixed)))
    assert sum(r["length"] for r in packed) == sum(map(len, ids.values()))
    sequences = collections.defaultdict(int)
    for r in packed:
        sequences[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 for n in sequences.values()) and sum(0 if n & (n - 1) == 0 else 2048 - n for n in sequences.values()) == 0
