import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pytest
import zstandard
from pyspark.sql import functions as F

from lexmill.llm import divergence, merkle, warc

# ---------------------------------------------------------------- divergence


def plain_audit(rows, min_docs, top=10):
    """Rows (lang, source, text), evaluated term by term."""
    import regex

    term = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = term.findall((text or "").translate(low))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        count = {s: {t: c[t] for t in kept} for (of, s), c in groups.items() if of == lang}
        whole = {t: sum(c[t] for c in count.values()) for t in kept}

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in p:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


def audited(df, **how):
    got = [tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_divergence_by_brute_force(spark):
    rng = np.random.default_rng(3)
    names = ["red", "Blue", "ÉTÉ", "été", "漢字", "x", "don't", "A1b", "🙂", "ﬀ"]
    rows = [(str(rng.choice(["en", "fr"])), f"s{rng.zipf(1.7) % 6}", " ".join(rng.choice(names, rng.integers(0, 9)))) for _ in range(200)]
    rows += [(None, None, None), ("", "s1", ""), ("de", "a", None), ("de", "b", "12 3"), ("de", None, "ja"), ("en", "quiet", None), *rows[:5]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, words string, lang_no int")
    assert audited(df, min_docs=10) == plain_audit(rows, 10)
    assert audited(df, min_docs=10, top=2) == plain_audit(rows, 10, 2)


def test_vocabulary_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "VOCABULARY_TERMS", 3)
    rows = [("en", f"s{i % 3}", f"a b c d e f g {'hijk'[i % 4]}") for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(df, min_docs=5) == plain_audit(rows, 5)


def test_vectors_are_made_of_groups_not_documents(spark, monkeypatch):
    seen = Counter()

    class Counting(divergence.CountVectorizer):
        def fit(self, rows):
            seen["words fitted"] += rows.select(F.sum(F.size("words"))).first()[0]
            model = super().fit(rows)
            transform = model.transform

            def counting(rows):
                seen["rows"] += rows.count()
                return transform(rows)

            model.transform = counting
            return model

    monkeypatch.setattr(divergence, "CountVectorizer", Counting)
    rows = [("en", f"s{i % 3}", f"{'abcd'[i % 4]} all of these a{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(2)
    assert audited(df) == plain_audit(rows, 10)
    assert seen["words fitted"] == 7 and seen["rows"] <= 6


@pytest.mark.parametrize("held, of_bag, of_terms", [(1 << 20, 40, 1 << 20), (60, 1 << 20, 5), (1, 1, 1)])
def test_what_a_task_holds_is_bounded(monkeypatch, held, of_bag, of_terms):
    for name, value in (("HELD_BYTES", held), ("BAG_BYTES", of_bag), ("HELD_TERMS", of_terms)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(i % 2, i % 3, f"Word{'abcd'[i % 4]} all, {'x ' * (i % 5)}") for i in range(60)] + [(0, 1, ""), (1, 2, "1 2")]
    columns = dict(zip(("lang_no", "source_no", "raw"), zip(*[(a, b, t.encode()) for a, b, t in rows])))
    table = pa.table(columns | {"raw": pa.array(columns["raw"], pa.binary())})
    want, docs = defaultdict(Counter), Counter()
    for lang, source, text in rows:
        found = text.lower().replace(",", "").split() if "1" not in text else []
        if found:
            want[lang, source].update(found)
            docs.update((lang, t) for t in set(found))
    got = defaultdict(Counter)
    for r in pa.Table.from_batches(divergence.bagged(iter(table.to_batches(7)))).to_pylist():
        got[r["lang_no"], r["source_no"]].update(r["text"].split(" "))
        assert len(r["text"]) < min(held, of_bag) + 20
    assert got == want
    found = Counter()
    for batch in divergence.counted(iter(table.to_batches(7))):
        assert len(batch) < of_terms + 5
        for r in batch.to_pylist():
            found[r["lang_no"], r["term"]] += r["n"]
    assert found == docs


def test_tiles_and_blocks(spark, monkeypatch):
    # as in a task, where blocks are small
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", 6)
    rng = np.random.default_rng(5)
    p = rng.integers(1, 10**9, (50, 7))
    p[rng.random(p.shape) < 0.5] = 1
    absent = {s: 1 for s in range(7)}
    for a, b in (({0: 1, 1: 1, 2: 1}, {3: 1, 4: 1, 5: 1, 6: 1}), (absent, absent)):
        tile = divergence.Tile(a, b)
        term, source = np.nonzero(p != 1)
        keep = np.isin(source, [*a, *b])
        term, source = term[keep], source[keep]
        for start in range(0, len(term), 11):
            part = slice(start, start + 11)
            tile.add(term[part], source[part], p[term, source][part])
        want = [[int(divergence.divergence(p[:, x], p[:, y]).sum()) for y in b] for x in a]
        assert tile.end(50).tolist() == want


def test_many_sources(spark):
    rows = [("en", f"s{i:04}", f"{'abcde'[i % 5]} {'qrstuvw'[i % 7]} all") for i in range(divergence.TILE + 40)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    out = divergence.audit(df, min_docs=10).filter("part = 'pair' and source in ('s0003', 's1050')").collect()
    assert len(out) == 2 * (len(rows) - 1)
    p = Counter()
    for _, _, t in rows:
        p.update(set(t.split()))
    v = sum(n >= 10 for n in p.values())
    share = lambda t, w: 1 + 10**9 * (t.split().count(w) + 2) // (3 + 2 * v)
    for r in out:
        x, y = rows[int(r.source[1:])][2], rows[int(r.item[1:])][2]
        total = sum((share(x, w) - share(y, w)) ** 2 // (share(x, w) + share(y, w)) for w in p)
        assert r.value == total


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(df).count() == 0
    assert audited(spark.createDataFrame([("en", "a", None), ("en", "b", "x")], df.schema)) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_share_of_large_counts(spark):
    n = 5 * 10**15
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(2 * n), F.lit(10**7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (2 * n + 2 * 10**7)


# --------------------------------------------------------------------- WARC

LONG = "<p>" + "the same words " * 200


def page_rows():
    rows = [(i, f"http://x/{i}", f"<html><body>page {i} " + "text and more " * (i % 90)) for i in range(300)]
    rows += [(1000, "http://a/ b\r\nX: y", LONG), (1001, "http://é", LONG), (1002, None, LONG), (1002, "twice", LONG)]
    rows += [(2000, "n", None), (2001, "e", ""), (None, "null", LONG), (3000, "s", "short"), (3001, "s", "short"), (4000, "big", "x" * 3_000_000)]
    return rows + [(None, "only nulls", LONG + "!"), (None, "only nulls", LONG + "!")]


PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def archived(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in page_rows()], PAGES + ", payload string, path string").repartition(3)
    index = warc.write(df, archive_bytes=2_000, training_bytes=20_000)
    return index, warc.read(spark, index).collect()


def bytes_of(uri):
    store, path = fs.FileSystem.from_uri(uri)
    # streams would undo compression that the name suggests
    with store.open_input_file(path) as source:
        return source.read()


def test_round_trip_of_pages(archived):
    index, got = archived
    want = []
    same = defaultdict(list)
    for i, _, html in page_rows():
        same[html or ""].append(i)
    for i, _, html in page_rows():
        b = (html or "").encode()
        ids = [x for x in same[html or ""] if x is not None]
        revisit = len(b) >= 1000 and ids and i != max(ids)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None, None if revisit else b))
    key = lambda r: tuple((x is not None, x) for x in r)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(rows, key=key) == sorted(want, key=key)
    urls = {(r.page_id, r.url) for r in got}
    assert (1000, "http://a/%20b%0D%0AX:%20y") in urls and (1001, "http://%C3%A9") in urls and (1002, None) in urls


def test_frames_and_random_access(archived):
    index, _ = archived
    rows = index.collect()
    assert len({r.path for r in rows}) > 3  # closed at their size
    for r in rows[::25]:
        record = warc.record_at(r.path, r.offset, r.length)
        assert warc.page_of(record)[0] == r.page_id and warc.page_of(record)[4] == r.record_type
    raw = bytes_of(rows[0].path)
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    size = int.from_bytes(raw[4:8], "little")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).stream_reader(raw, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 1 + sum(r.path == rows[0].path for r in rows)
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(raw[rows[0].offset : rows[0].offset + rows[0].length])


def test_broken_archives(archived, tmp_path):
    index, _ = archived
    raw = bytes_of(index.first().path)
    (tmp_path / "cut.warc.zst").write_bytes(raw[:-3])
    with pytest.raises(ValueError, match="ends within a record"):
        list(warc.records(str(tmp_path / "cut.warc.zst")))
    record = warc.page_record(1, "u", b"x" * 50, True, None)
    with pytest.raises(ValueError, match="does not fit"):
        warc.page_of(record.replace(b"xxx", b"xxy", 1))


def test_no_pages(spark):
    index = warc.write(spark.createDataFrame([], PAGES))
    assert index.count() == 0 and warc.read(spark, index).count() == 0


def test_small_sample_is_a_dictionary():
    assert warc.train_dictionary([b"one record"]) == b"one record"


# ------------------------------------------------------------------- Merkle


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([sha(a[i : i + 3]) for i in range(0, len(a), 3)])
    return levels


def path_in(levels, i):
    out = []
    for a in levels[:-1]:
        j = i // 3 * 3
        out.append((a[j:i], a[i + 1 : j + 3]))
        i //= 3
    return out


def plain_manifest(rows, changed):
    """(doc_id, leaf, subroot, root, proof, root found) from whole levels; rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, text: sha(map(entry, [*r[:4], text]))
    order = lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[4]))
    trees = [list(g) for _, g in groupby(sorted(rows, key=order), key=lambda r: r[1])]
    levels = [levels_of([leaf(r, r[4]) for r in g]) for g in trees]
    top, out = levels_of([x[-1][0] for x in levels]), []
    for k, (g, lv) in enumerate(zip(trees, levels)):
        for i, r in enumerate(g):
            path = path_in(lv, i) + path_in(top, k)
            now = leaf(r, changed(r))
            for a, b in path:
                now = sha([*a, now, *b])
            out.append((r[0], lv[0][i], lv[-1][0], top[-1][0], sha(x for a, b in path for x in a + b), now))
    return sorted(out, key=repr)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, witness string, position string"


@pytest.mark.parametrize("levels", [2, 6])
def test_manifest_by_brute_force(spark, awkward, levels):
    rows = [(i, f"s{i % 4}" if i % 3 else "hot", "en", i, f"line {i}\nnext") for i in range(160)]
    rows += [(i, None if j % 2 else "", None, None, t) for j, (i, t) in enumerate(awkward)] + rows[:3]
    rows += [(900, "é", "x", 1, None), (901, "alone", None, 0, "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], MERKLE).repartition(3)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = merkle.manifest(df, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), levels=levels)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, hashlib.sha256(bytes(r.witness).hex().encode()).hexdigest(), r.found_root) for r in out.collect()]
    changed = lambda r: r[4].replace("\n", "") if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
    assert sorted(got, key=repr) == plain_manifest(rows, changed)
    assert {r[3] == r[5] for r in got} == {True, False}


def test_witnesses_grow_as_nodes_are_appended():
    tree, digests = merkle.OpenTree(), [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    for i, d in enumerate(digests):
        tree.append(d)
        # complete runs have extended the witnesses below them, open ones not yet
        assert [len(s) for s in tree.shape[:3]] == [min(1, (i + 1) // 3) + (i + 1) // 9] * min(3, i + 1)
    root = tree.finish()
    assert {merkle.folded(d, bytes(w), bytes(s)) for d, w, s in zip(digests, tree.witness, tree.shape)} == {root}
    assert root.hex() == levels_of([d.hex() for d in digests])[-1][0]


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "s", None, 3, "abc", "", "")], MERKLE)
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.found_root == sha(["1:1", "1:s", "-", "1:3", "3:abc"]) and bytes(row.witness) == b""
    assert merkle.manifest(one.limit(0)).count() == 0
