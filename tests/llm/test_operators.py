"""Each operator against brute force on small inputs with nulls, ties, repeats and long texts."""

import hashlib
import itertools
import random
import zlib

import brute
import numpy as np
import pandas as pd
import pytest

from screenlake.llm import byte_bpe, byte_repeats, chat_tree, containment, graph, language_id, repeats, sharding, simhash, url_filter, vector_links, word_repeats, words

SOURCE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, kept string, fingerprint int, ids string, component_id string"


def texts():
    """Documents with clashing extra columns: shared passages, copies, nulls, empties, long ones, repeated ids."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(1, 7))) for _ in range(300)]
    passage = [" ".join(r.choices(vocabulary, k=r.randint(60, 120))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 80)))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passage), " ".join(r.choices(vocabulary, k=r.randint(0, 30)))]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(parts)))
    base = rows[3][1].split(" ")
    for i in range(60, 75):  # near copies
        copy = list(base)
        copy[r.randrange(len(copy))] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(80, None), (81, ""), (82, " \n\t"), (83, "one two"), (84, rows[3][1]), (84, rows[3][1]), (85, rows[4][1]), (85, rows[5][1]), (None, rows[3][1]), (None, None)]
    rows += [(90, "again and " * 400), (91, "again and " * 300 + "then"), (92, passage[0][:51]), (93, "x" * 3000), (94, "x" * 60)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "i", "s") for i, t in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- words


def test_words_and_segments():
    for raw in (b"", b"  ", b" a  b\n\x0bc ", b"abc", b"a\xc3\xa9\x1cb \x85"):
        norm, starts, ends = words.normalised(raw)
        found = brute.WORD.findall(raw)
        assert norm.tobytes() == b" ".join(found) and [norm[a:b].tobytes() for a, b in zip(starts, ends)] == found
    data = " ".join(str(i) * (i % 5 + 1) for i in range(400)).encode()
    got = []
    for part in words.segments(data, 4, limit=50):
        w = part.split()
        got += [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
    w = data.split()
    assert got == [tuple(w[i : i + 4]) for i in range(len(w) - 3)]


# --- 1: chat formatting


def chats():
    a, b = "</s>[INST] ok [/INST]", "back\\slash \\L <s> é\n"
    long = [(7, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(700)]
    return [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", a),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "other"), (2, 3, "assistant", b),
        (3, 0, "user", "hi"), (3, 1, "assistant", "else"), (4, 0, "user", "hi"), (4, 1, "assistant", "hello"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "hello"), (5, 2, "user", a), (6, 0, "user", None), (6, 1, None, "no role"),
        (6, 1, None, "no role"), (6, None, "system", "first"), (None, 0, "user", "nobody"), (8, 0, "user\nx<", ""), (-1, 0, "assistant", a), *long,
        *[(9, i, r, t) for _, i, r, t in long[:300]], (9, 300, "user", "leaves"),
    ]


@pytest.fixture(scope="module")
def tree(spark):
    turns = spark.createDataFrame([(*c, "x") for c in chats()], "conv_id long, turn long, role string, text string, tree string").repartition(3)
    nodes, paths = chat_tree.prefix_tree(turns, brute.PATH, brute.PATTERN)
    return nodes.cache(), paths.cache()


def conversations():
    key = lambda c: (c[1] is not None, c[1] or 0, c[2] or "", c[3] or "")
    out = {}
    for c in chats():
        out.setdefault(c[0], []).append(c)
    return {k: [(r or "", t or "") for _, _, r, t in sorted(v, key=key)] for k, v in out.items()}


def test_chat_round_trip(tree):
    got = {r["conv_id"]: r for r in chat_tree.read_back(*tree, brute.PATH, brute.PATTERN).collect()}
    want = conversations()
    assert set(got) == set(want)
    for conv, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for a, b in turns).encode()))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), brute.sha(learned.encode()))


def test_chat_tree_shares_and_masks(tree):
    nodes, paths = (df.collect() for df in tree)
    want = conversations()
    prefixes = {tuple(t[: i + 1]) for t in want.values() for i in range(len(t))}
    assert len(nodes) == len(prefixes)
    by = {(n["chain"], n["depth"]): n for n in nodes}
    for tree_id, group in itertools.groupby(sorted(nodes, key=lambda n: (n["tree"], n["start"])), key=lambda n: n["tree"]):
        at = 0
        for n in group:  # one packed sequence without gaps
            assert n["start"] == at, tree_id
            at += n["n_tokens"]
    for p in paths:
        path = [*p["path"], None]
        turns = [by[s["chain"], d] for s, after in zip(path, path[1:]) for d in range(s["depth"], after["depth"] if after else p["n_turns"])]
        position, seen = 0, []
        for n in turns:
            assert n["position"] == position
            position += n["n_tokens"]
            seen += range(n["start"], n["start"] + n["n_tokens"])
            assert sorted(x for i in n["sees"] for x in range(i["begin"], i["end"])) == sorted(seen)
        want_turns = want[p["conv_id"]]
        assert [n["role"] for n in turns] == [r for r, _ in want_turns]


def test_chat_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nodes, paths = chat_tree.prefix_tree(empty, brute.PATH, brute.PATTERN)
    assert chat_tree.read_back(nodes, paths, brute.PATH, brute.PATTERN).count() == 0


# --- 2: SimHash


@pytest.mark.parametrize("fold", [20_000, 3])
def test_simhash(docs, rows, fold):
    out = simhash.near_duplicates(docs, fold=fold)
    assert out.columns == ["doc_id", "kept", "ids", "fingerprint", "component_id"]
    assert listed(out, "doc_id", "fingerprint", "component_id") == sorted(brute.near_duplicates(rows), key=repr)


@pytest.mark.parametrize("fold", [10_000, 2])
def test_simhash_links_are_complete(spark, fold):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**64, 6, dtype=np.uint64)
    near = np.array([b ^ np.uint64(sum(1 << int(k) for k in r.choice(64, r.integers(0, 8), replace=False))) for b in base for _ in range(25)], np.uint64)
    fps = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(15), np.uint64(255)]]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), fold=fold)
    found = {x["node"]: x["root"] for x in graph.components(edges).collect()}
    root = brute.reachable(len(fps), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 4)
    groups = {}
    for x, g in zip(fps.view(np.int64).tolist(), root):
        groups.setdefault(g, []).append(x)
    assert all(found.get(x, x) == min(g) for g in groups.values() for x in g)


def test_simhash_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(900, 900), (901, 902), (902, 901)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(500, 560), 500), 901: 901, 902: 901}


# --- 3 and 6: repeated bytes and words


@pytest.mark.parametrize("many", [64, 2])
def test_byte_repeats(docs, rows, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    out = byte_repeats.remove_repeats(docs, 50)
    assert out.columns == ["doc_id", "fingerprint", "ids", "component_id", "kept", "n_bytes", "n_removed", "n_spans"]
    want = [(i, *brute.byte_row(s, m)) for (i, _), (s, m) in zip(rows, brute.removed(rows, 50, brute.bytes_of))]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("window", "block"), [(50, 5), (20, 4)])
def test_word_repeats(docs, rows, window, block):
    out = word_repeats.remove_repeats(docs, window, block)
    want = [(i, b" ".join(w for w, x in zip(s, m) if not x).decode(), len(s), sum(m)) for (i, _), (s, m) in zip(rows, brute.removed(rows, window, brute.words_of))]
    assert sum(w[3] for w in want) > 0
    assert listed(out, "doc_id", "kept", "n_words", "n_removed") == sorted(want, key=repr)


def test_word_repeats_one_window(spark):
    """Documents of one window inside longer ones, on either side, and passages that open or end a document."""
    r = random.Random(8)
    fresh = lambda n: ["".join(r.choices("abcdefgh", k=8)) for _ in range(n)]
    cases = []
    for k in range(40):
        short = fresh(50)
        inside = fresh(20 + k) + short + fresh(30)
        cases += [short, inside] if k % 2 else [inside, short]
        shared = fresh(50 + k)
        cases += [shared + fresh(60), fresh(60) + shared]
    rows = [(i, " ".join(w)) for i, w in enumerate(cases)]
    out = word_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = [(i, len(s), sum(m)) for (i, _), (s, m) in zip(rows, brute.removed(rows, 50, brute.words_of))]
    assert sum(w[2] > 0 for w in want) == 80
    assert listed(out, "doc_id", "n_words", "n_removed") == sorted(want, key=repr)


def test_plans_cut_long_texts_alike(monkeypatch):
    data = " ".join(random.Random(2).choices(["ab", "cde", "f", "ghij"], k=3000)).encode()
    for plan in (repeats.Plan(repeats.ByteUnits, 50, 16, 1), repeats.Plan(repeats.WordUnits, 50, 5, 5)):
        whole = repeats.run_names(plan.units.names([data])[0], 50)
        monkeypatch.setattr(repeats, "PIECE", 700)
        found = {}
        for piece in plan.units.pieces(0, data, 50):
            for i, name in enumerate(repeats.run_names(plan.units.names([piece[2]])[0], 50).tolist()):
                assert piece[1] + i not in found
                found[piece[1] + i] = name
        assert [found[i] for i in range(len(whole))] == whole.tolist()
        monkeypatch.undo()


def test_repeats_nothing(nothing):
    assert byte_repeats.remove_repeats(nothing).count() == 0
    assert word_repeats.remove_repeats(nothing).count() == 0


# --- 4: sharding


def test_sharding(docs, rows):
    got = sharding.assign_shards(docs, 8).collect()
    want = sorted(((i, len(brute.bytes_of(t)) + 1, zlib.crc32(brute.bytes_of(t)), brute.jump(i or 0, 8), brute.jump(i or 0, 9)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got), key=repr) == want
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 9, 500):
        assert [r[0] for r in df.select(sharding.jump_hash(df.k, n)).collect()] == [brute.jump(k, n) for k in keys]


def test_sharding_nothing(nothing):
    assert sharding.assign_shards(nothing, 8).count() == 0


# --- 5: language


def test_language_id(spark):
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    out = language_id.identify(docs).toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.9 and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out.doc_id, out.held_out))


def test_language_id_cases(spark, nothing):
    schema = "doc_id long, text string, lang string, score string"
    some = [(i, t, g, "x") for i in range(0, 60, 2) for t, g in (("der die und", "de"), ("the and of", "en"))]
    docs = spark.createDataFrame([*some, (1001, None, "de", "x"), (1002, "", "de", "x"), (1003, "12 -- 3", "de", "x"), (None, "the of", "en", "x"), (1004, "und die " * 40000, None, "x")], schema)
    got = {(r["doc_id"], r["text"]): r for r in language_id.identify(docs).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in ((1001, None), (1002, ""), (1003, "12 -- 3")))
    assert got[None, "the of"]["lang_pred"] == "en" and not got[None, "the of"]["held_out"]
    assert got[1004, "und die " * 40000]["lang_pred"] == "de"
    unlabelled = language_id.identify(docs.where("doc_id > 1000"))
    assert {r["lang_pred"] for r in unlabelled.where("doc_id = 1004").collect()} == {"und"}
    assert language_id.identify(nothing.selectExpr("doc_id", "text", "'x' AS lang")).count() == 0


def test_language_counts_are_the_same_in_segments(monkeypatch):
    text = "Äpfel und Birnen " * 50
    whole = language_id.counts([text, "kurz", ""])
    monkeypatch.setattr(language_id, "SEGMENT", 37)
    assert (language_id.counts([text, "kurz", ""]) == whole).all()
    assert whole[2].sum() == 3  # two blanks and their pair


# --- 7: decontamination


def items():
    rows = texts()
    r = random.Random(9)
    out = []
    for i in range(12):
        w = (rows[i][1] or "").split()
        at = r.randrange(max(1, len(w) - 40))
        w = w[at : at + 40]
        for _ in range(i % 4):
            if w:
                w[r.randrange(len(w))] = "other"
        out.append((i, " ".join(w).upper().replace("É", "é").replace("SS", "ß")))
    return [*out, (20, None), (21, ""), (22, "ONE two"), (23, "one"), (None, out[1][1]), (24, out[1][1])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_containment(spark, docs, rows, block_bytes):
    benchmark = spark.createDataFrame([(*i, 5) for i in items()], "item_id long, text string, doc_id int")
    out = containment.contained_items(docs, benchmark, block_bytes=block_bytes)
    want = brute.contained(rows, items())
    assert len(want) > 5 and listed(out, "doc_id", "item_id", "n_shared", "n_item") == sorted(want, key=repr)
    clean = containment.drop_contaminated(docs, benchmark, block_bytes=block_bytes)
    bad = {(t) for (d, t) in rows if brute.contained([(0, t)], items())}
    assert clean.columns == docs.columns and listed(clean, "doc_id", "text") == sorted(((d, t) for d, t in rows if t not in bad), key=repr)


def test_containment_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert containment.contained_items(docs, none).count() == 0 and containment.drop_contaminated(docs, none).count() == docs.count()
    assert containment.contained_items(nothing, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- 8: vectors


def vectors():
    r = np.random.default_rng(1)
    centre = r.standard_normal((15, 32))
    rows = [(i, (centre[i % 15] + (0.02 + 0.02 * (i % 7)) * r.standard_normal(32)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (301, rows[0][1]), (302, [2 * x for x in rows[1][1]]), (303, None), (304, []), (305, [0.0] * 32), (306, [float("nan")] + [1.0] * 31)]
    return [*rows, (307, [float("inf")] + [1.0] * 31), (308, [None] + [1.0] * 31), (309, rows[2][1][:16]), (None, rows[3][1]), (310, [1e-30] * 32), (311, [1e30] * 32)]


def test_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<float>, n_links int, label string").repartition(3)
    out = vector_links.near_duplicates(df).collect()
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for _, v in rows]

    def linked(i, j):
        if i == j or not (good[i] and good[j]) or len(rows[i][1]) != len(rows[j][1]):
            return False
        x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95

    links = [sum(linked(i, j) for j in range(len(rows))) for i in range(len(rows))]
    root = brute.reachable(len(rows), linked)
    assert len(out) == len(rows) and set(out[0].asDict()) == {"vec_id", "label", "n_links", "component_id", "kept"}
    got = sum(r["n_links"] for r in out)
    assert 0.95 * sum(links) <= got <= sum(links)
    first = {}
    for (i, _), g in zip(rows, root):
        first[g] = min(i if i is not None else 10**9, first.get(g, 10**9))
    want = {i: first[g] for (i, _), g in zip(rows, root) if i is not None}
    assert np.mean([r["component_id"] == want[r["vec_id"]] for r in out if r["vec_id"] is not None]) >= 0.95
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)


def test_vectors_nothing(spark):
    assert vector_links.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 9: byte-level BPE


def test_bpe(docs, rows):
    encoder = brute.encoder()
    odd = "é😀 \u00a0x" + "".join(chr(c) for c in range(1, 0x250))
    out = byte_bpe.decode(byte_bpe.encode(docs, brute.PATH, brute.PATTERN, offsets=True), brute.PATH).collect()
    want = sorted(((i, brute.packed(encoder.encode_ordinary(t or "")), brute.bytes_of(t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out), key=repr) == want
    for r in out:
        assert r["n_tokens"] == len(r["ids"]) // 4 == len(r["byte_starts"]) and r["decoded_text"] == (r["text"] or "")
    with open(brute.PATH, "rb") as file:
        codec = byte_bpe.Codec.of(file.read(), brute.PATTERN)
    ids = codec.encode(odd)
    assert ids == brute.packed(encoder.encode_ordinary(odd)) and codec.decode(ids) == odd.encode()
    first, character = codec.starts(ids)
    data = odd.encode()
    owner = [k for k, c in enumerate(odd) for _ in c.encode()]
    assert character == [owner[b] for b in first]
    split = codec.encode("a😀")[:8]  # the first of several tokens of the character
    assert codec.decode(split).decode("utf-8", "replace").endswith("\ufffd")


def test_bpe_long_texts_in_parts(monkeypatch):
    with open(brute.PATH, "rb") as file:
        codec = byte_bpe.Codec.of(file.read(), brute.PATTERN)
    text = "Viele Wörter, 123  viele\n\n Wörter " * 40
    whole = codec.encode(text)
    monkeypatch.setattr(byte_bpe, "PIECES_AT_ONCE", 7)
    monkeypatch.setattr(byte_bpe, "PIECES_KEPT", 5)
    assert codec.encode(text) == whole


def test_bpe_nothing(nothing):
    assert byte_bpe.decode(byte_bpe.encode(nothing, brute.PATH, brute.PATTERN), brute.PATH).count() == 0


# --- 10: URLs

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def pages():
    to = lambda *hosts: "".join(f"<a HREF = 'https://{h}/x'>l</a><img src=//{h}>" for h in hosts)
    return [
        (1, "https://good.org/a", to("friend.net", "FRIEND.net")), (2, "http://x.Example.ORG/es/1?q#f", to("good.org")), (3, "https://example.org/en/12", None), (4, "https://example.org/en/2", ""),
        (5, "https://bad.com/de/1", to("friend.net")), (6, "https://farm.net/1", to("bad.com", "worse.com")), (7, "https://worse.com/de/", to("bad.com")), (8, "https://friend.net/", to("friend2.net")),
        (9, "https://friend2.net", None), (10, None, to("bad.com")), (11, "no scheme", None), (12, "x://", None), (13, "a://h?x://y/fr/", None), (14, "https://notcom/fr/", None), (15, "https://a.com/fr/de/", None), (15, "https://a.com/fr/de/", None),
        (16, "https://farm.net/2", to("bad.com")), (17, "https://alone.net/", '<a href="/en/">'), (None, "https://org/", None),
    ]


def test_url_filter(spark):
    df = spark.createDataFrame([(*p, "x") for p in pages()], "page_id long, url string, html string, host string")
    out = url_filter.filter_urls(df, RULES)
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()), key=repr)
    want, judged = [], []
    for i, url, _ in pages():
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = next((rest[:k] for k in range(len(rest)) if rest[k] in "/?#"), rest)
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged.append((i, host, path, *(max(fits)[1:] if fits else (None, None))))
    import re

    edges = {}
    for (_, host, *_), (_, _, html) in zip(judged, pages()):
        for h in re.findall(r"//([a-z0-9.]+)", (html or "").lower()):
            if host and h != host:
                edges[host, h] = edges.get((host, h), 0) + 1
    score = {}
    for kind in ("allow", "block"):
        mine = {}
        for _, host, _, _, v in judged:
            if v == kind:
                mine[host] = mine.get(host, 0) + 1
        seed = {h: n / sum(mine.values()) for h, n in mine.items()}
        way = edges if kind == "allow" else {(b, a): n for (a, b), n in edges.items()}
        total = {}
        for (a, _), n in way.items():
            total[a] = total.get(a, 0) + n
        now = dict(seed)
        for _ in range(60):
            new = {h: 0.15 * s for h, s in seed.items()}
            for (a, b), n in way.items():
                new[b] = new.get(b, 0) + 0.85 * now.get(a, 0) * n / total[a]
            now = new
        score[kind] = {h: s / sum(now.values()) for h, s in now.items()}
    for i, host, path, rule, v in judged:
        t, d = (score[k].get(host, 0) for k in ("allow", "block"))
        want.append((i, host, path, rule, v or ("block" if d > 0.75 * (t + d) else "allow")))
    assert got == sorted(want, key=repr)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[6] == "block" and verdict[8] == verdict[9] == verdict[17] == "allow"


def test_url_filter_reaches_hosts_at_any_distance(spark):
    rows = [(k, f"https://h{k}.net/", f'<a href="//h{k + 1}.net/">') for k in range(33)] + [(33, "https://h33.net/", '<a href="//bad.com">'), (34, "https://bad.com/de/", None), (35, "https://h35.net/", None)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), RULES)
    got = {r["page_id"]: (r["verdict"], r["distrust"]) for r in out.collect()}
    assert [v for v, _ in (got[k] for k in range(36))] == ["block"] * 35 + ["allow"]
    assert all(abs(got[k][1] / got[k + 1][1] - 0.85) < 1e-4 for k in range(34))


def test_url_filter_nothing(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


# --- the registered queries


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Different texts of one id, near copies of another id beside them, equal rows and rows without an id."""
    import corpus_pipeline

    r = random.Random(3)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=8)) for _ in range(80))
    one, two, three, four, five = (text() for _ in range(5))
    rows = [(1, one), (7, one), (7, two), (8, three), (8, four), (8, four), (9, five), (None, five), (None, "lone"), (None, "lone"), (9, three), (5, None), (6, "")]
    want = [(1, one), (7, two), (8, three), (8, four), (9, five), (None, "lone"), (5, None)]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "k") for i, t in some], "doc_id long, text string, source string").repartition(3)
        out = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SOURCE)
        assert out.columns == docs.columns
        assert listed(out, "doc_id", "text") == sorted(want, key=repr)
    hot = spark.createDataFrame([(4, text()) for _ in range(50)], "doc_id long, text string")
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, hot, SOURCE).count() == 50


def test_queries_and_pipeline(spark, tmp_path):
    import corpus_pipeline
    from screenlake.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    table = pd.read_parquet(f"{SOURCE}/documents.parquet")
    rows = list(zip(table.doc_id.tolist(), table.text.tolist()))
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.keep_known_language(spark, spark.read.parquet(f"{SOURCE}/documents.parquet"), SOURCE).collect()}
    assert len(kept) >= 0.95 * len(rows)
    rows = [(i, t) for i, t in rows if i in kept]
    first = {i for i, _, c in brute.near_duplicates(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in first]
    cut = []
    for (i, t), (s, m) in zip(rows, brute.removed(rows, 50, brute.words_of)):
        if not any(m) or not all(m):
            cut.append((i, t if not any(m) else b" ".join(w for w, x in zip(s, m) if not x).decode()))
    items = pd.read_parquet(f"{SOURCE}/benchmark.parquet")
    leaked = {d for d, *_ in brute.contained(cut, list(zip(items.item_id.tolist(), items.text.tolist())))}
    encoder = brute.encoder()
    want = sorted((i, brute.packed(encoder.encode_ordinary(t)), t) for i, t in cut if i not in leaked)
    got = sorted((r["doc_id"], bytes(r["ids"]), r["decoded_text"]) for r in corpus_pipeline.run(spark, SOURCE).collect())
    assert got == want
    assert hashlib.sha256(b"").hexdigest() == brute.sha(b"")
