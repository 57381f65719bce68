"""Secret scan, collocations and source divergence against brute force, and rows that share an id."""

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from screenlake.llm import byte_repeats, collocations, repeats, secret_scan, source_divergence, word_repeats

DOCS = "doc_id long, text string, lang string, source string, row long, rank int, secrets int"


def corpus():
    """Nulls, empties, ties, repeated rows, other alphabets, one long text, clashing columns."""
    r = random.Random(4)
    words = ["the", "of", "New", "York", "city", "éclair", "ÉTÉ", "x1y", "naïve", "日本語", "a-b"]
    rows = []
    for i in range(160):
        n = r.choice([0, 3, 20, 60])
        text = "".join(r.choice(["New York city", "the of", *words]) + r.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(n))
        rows.append((i, text, r.choice(["en", "fr", "de", None]), r.choice(["s0", "s1", "s2", "é", None])))
    rows += [(1, None, "en", "s0"), (None, "New York city", None, None), (7, "", "zz", "only"), (8, "lone words here", "xx", "b"), (9, "other", "xx", "a")]
    rows += [rows[5]] * 3 + [(200, "New York city of the " * 4000, "en", "s1"), (201, "word" * 3000, "en", "s2")]
    return [(i, t, la, s, 1, 2, 3) for i, t, la, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- 11: secrets


def base(text):
    """The base spans by the plain patterns."""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


SNIPPETS = [
    "password = hunter2", 'Passwd": "abc', "token: token: abcdef", "SECRET==x/y+z.1", "api_key='k-1_2=3'", "apiKEY:abcdefg", "AKIA" + "A1" * 8, "AKIA" * 5, "AKIA123", "AKIAAKIA" + "Z" * 15, "0" * 23, "ab12" * 6, "f" * 60,
    "toKen: abcdefgh", "ſecret: abcdefgh", "😀", "ß", "\n", "x", '"', "'", ":", " ", "=", 'db_pass = "s3cr3tXY"', "a=b", "pw = 'w8Zq!pLm'\nadmin_password = pw", "max_tokens = 1234567",
]


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(SNIPPETS) for _ in range(r.randint(0, 9)))
        got = secret_scan.secrets(text)
        assert [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in got if s.kind != "literal"] == base(text), text
        assert got == sorted(got, key=lambda s: (s.start, secret_scan.KINDS.index(s.kind), s.end))
        covers = [(s.start, s.end) for s in got if s.kind != "literal"]
        assert not any(a <= s.start and s.end <= b for s in got if s.kind == "literal" for a, b in covers)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('db_password = "correct horse battery"', ["correct horse battery"]),
        ('pw = "s3cr3tX9"\ndb_passphrase = pw', ["s3cr3tX9"]),
        ('smtp_pass = site\nsite = other\nother = "s3cr3tX9"', ["s3cr3tX9"]),
        ("a = b\nb = a\nc = a", []),
        ('<add key="DbPassword" value="abc123XYZ"/>', ["abc123XYZ"]),
        ("- name: DB_PASS\n  value: hunter2x9", ["hunter2x9"]),
        ("export SIGNING_KEY=abcd1234efgh", ["abcd1234efgh"]),
        ('url = "postgres://u:p4ssw0rd@host/db"', ["p4ssw0rd"]),
        ("<clientSecret>zzz999yyy</clientSecret>", ["zzz999yyy"]),
        ('a = {"privateKey": "ab" + "cd99ef"}', ["ab", "cd99ef"]),
        ("X1=abc12345\nauth_jwt: ${X1}", ["abc12345"]),
        ('cs = "Server=x;Pwd=abX12345;User=u"', ["abX12345"]),
        ("credentials = '''multi1\nline2X'''", ["multi1\nline2X"]),
        ("max_tokens = 1234567", []), ('password_label = "Enter it here"', []), ("pwd = os.getenv('HOME_DIR1')", []), ("pwd = '${VAULT_VALUE1}'", []), ("The pass: over the hill", []), ("x::y = 5", []), ("", []), (None, []),
    ],
)
def test_literals_follow_their_names(text, found):
    assert [text[s.start : s.end] for s in secret_scan.secrets(text) if s.kind == "literal"] == found


def test_secret_scan_is_linear_in_the_text():
    import time

    start = time.perf_counter()
    for bad in ("x=", "a:", '="', 'x="a"+', "<a ", "http://a:", "x=\n\"", "x='y\" z=\"", 'x="\\"', "x=`", "x=(", "'''", "$", "a.b-", "password:"):
        secret_scan.secrets(bad * 20_000)
    assert time.perf_counter() - start < 30


def test_secret_query_and_redaction(spark, docs, nothing):
    mixed = spark.createDataFrame([(1, 'token = "abcdefgh" and AKIA' + "B" * 16, 5), (1, None, 5), (None, "pw = 'w8Zq!pLm'\nadmin_password = pw", 5), (2, "clean", 5)], "doc_id long, text string, secrets int")
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in secret_scan.digest(secret_scan.find_secrets(mixed)).collect()}
    empty = brute.sha(b"")
    assert got == {(1, 1, 1, 0, brute.sha(b"assign:0:17,access:23:43"), "assign:0:17,access:23:43"), (1, 0, 0, 0, empty, ""), (None, 0, 0, 0, empty, "literal:6:14"), (2, 0, 0, 0, empty, "")}
    assert {r["text"] for r in secret_scan.redact(mixed).collect()} == {'[secret]" and [secret]', None, "pw = '[secret]'\nadmin_password = pw", "clean"}
    assert secret_scan.find_secrets(docs).count() == docs.count() and secret_scan.find_secrets(nothing).count() == 0


# --- 12: collocations


def best_phrases(rows, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            longer = max((b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if 100 * longer < 50 * a:
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (2, 3, 5), (4, 5, 2000)])
def test_collocations(docs, rows, longest, least, top):
    got = collocations.collocations(docs, longest, least, top=top).collect()
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}
    assert sorted(tuple(r) for r in got) == best_phrases(rows, longest, least, top)


def test_collocations_of_nothing(spark, nothing):
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, ". ,", "en")], "doc_id long, text string, lang string")).count() == 0


def test_fingerprints_of_a_chunk(monkeypatch):
    chunk = collocations._Chunk([(0, b"a b c. a b"), (1, b"b c")], ["en", "fr"])
    fp, check, counts, row, at = chunk.occurrences(2, None)
    assert sorted(zip(counts.tolist(), row.tolist(), [chunk.text(i, 2) for i in at.tolist()])) == [(1, 0, "b c"), (1, 1, "b c"), (2, 0, "a b")]
    assert len(set(fp.tolist())) == len(set(check.tolist())) == 3
    # the same phrase has the same names in another chunk
    again = collocations._Chunk([(5, b"x a  b")], ["en"])
    mine = [chunk.text(i, 2) for i in at.tolist()].index("a b")
    assert fp[mine] == again.fingerprints(2)[1] and check[mine] == again.checks(2)[1]
    # where fingerprints collide, n-grams stay apart and checks differ
    full = collocations._Chunk.fingerprints
    monkeypatch.setattr(collocations._Chunk, "fingerprints", lambda self, n, which=0: full(self, n, which) & np.uint64(3) if which == 0 else full(self, n, which))
    fp, check, counts, *_ = collocations._Chunk([(0, b"a b c d e f g a b")], ["en"]).occurrences(2, None)
    assert len(set(fp.tolist())) <= 4 and len(set(check.tolist())) == 7 and counts.sum() == 8


@pytest.mark.parametrize("n", [1, 2, 3])
def test_segments_hold_every_run_once(n):
    data = " ".join(str(i) * (i % 7 + 1) + "," * (i % 5 == 0) for i in range(500)).encode()
    words = re.findall(rb"[^ ,]+", data)
    got = []
    for part in collocations.segments(data, n, 60):
        w = re.findall(rb"[^ ,]+", part)
        got += [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    assert got == [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


# --- 13: source divergence


def differences(rows, least, top):
    docs, counts, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (la, t), n in docs.items() if la == lang and n >= least)
        whole = {t: sum(counts[lang, s, t] for s in sources) for t in kept}

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (n + 2) // (total + 2 * len(kept)) for t, n in c.items()}

        q = shares(whole)
        p = {s: shares({t: counts[lang, s, t] for t in kept}) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)]
    return sorted(out)


def test_source_divergence(docs, rows):
    got = source_divergence.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == differences(rows, 10, 10)


def test_source_divergence_by_tiles(spark, monkeypatch):
    """Many sources, so that blocks of sources meet each other."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(["one", "two", "three", "four", "fünf"], k=9)), "en", f"s{i % 300}") for i in range(900)]
    got = source_divergence.divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), 10, 2)
    assert sorted(tuple(x) for x in got.collect()) == differences(rows, 10, 2)


def test_source_divergence_of_nothing(spark, nothing):
    assert source_divergence.divergence(nothing).count() == 0
    lone = spark.createDataFrame([(1, None, None, None), (2, "", "", "x")], "doc_id long, text string, lang string, source string")
    assert sorted(tuple(r) for r in source_divergence.divergence(lone).collect()) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_terms_of_long_texts_in_segments():
    text = ("word" * 50 + " é b ").encode() * 40
    assert b"".join(source_divergence._pieces(text, 100)) == text
    parts = list(source_divergence._pieces(text, 100))
    found = [t for p in parts for t in re.findall(rb"[A-Za-z\x80-\xff]+", p)]
    assert found == re.findall(rb"[A-Za-z\x80-\xff]+", text)


# --- 3 and 6: many rows of one id


@pytest.mark.parametrize("units", ["bytes", "words"])
def test_thousands_of_rows_of_one_id(spark, units):
    r = random.Random(1)
    shared = [" ".join(r.choices("abcdefghijklmnop", k=70)) for _ in range(5)]
    rows = [(1, " ".join([str(i), r.choice(shared), str(i * 7)]) if i % 3 else f"{i} alone") for i in range(3000)]
    rows += [(0, shared[0]), (2, shared[1]), (2, shared[1] + " more"), (None, shared[2]), (None, shared[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if units == "bytes":
        got = sorted(((x["doc_id"], bytes(x["kept"])) for x in byte_repeats.remove_repeats(docs).select("doc_id", "kept").collect()), key=repr)
        want = sorted(((i, brute.byte_row(s, m)[3]) for (i, _), (s, m) in zip(rows, brute.removed(rows, 50, brute.bytes_of))), key=repr)
    else:
        got = sorted(((x["doc_id"], x["kept"]) for x in word_repeats.remove_repeats(docs).select("doc_id", "kept").collect()), key=repr)
        want = sorted(((i, b" ".join(w for w, c in zip(s, m) if not c).decode()) for (i, _), (s, m) in zip(rows, brute.removed(rows, 50, brute.words_of))), key=repr)
    assert got == want
    assert repeats.covered(None, 50)[0].size == 0
