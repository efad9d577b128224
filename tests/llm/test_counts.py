"""Divergence of sources, collocations and WARC archives against brute force, and on nulls, ties, repeats and empty tables."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from taktwerk.llm import warc
from taktwerk.llm.collocation import WORDS, Automaton, Filter, mine
from taktwerk.llm.divergence import audit, shares
from taktwerk.llm.words import Words

COLUMNS = "doc_id long, text string, lang string, source string, n string, term string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "clash", "clash", "clash") for i, (t, lang, source) in enumerate(rows)], COLUMNS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def divergences(rows, least):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(t))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for own, _, ws in docs if own == lang for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for own, source, ws in docs:
            if own == lang:
                counts[source].update(w for w in ws if w in kept)
                counts[None].update(w for w in ws if w in kept)
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept} for s, c in counts.items()}
        for s in p:
            if s is None:
                continue
            f = lambda a, b: (a - b) ** 2 // (a + b)
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in p if o not in (None, s))
            terms = sorted((-f(p[s][w], p[None][w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > p[None][w])[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [3, 1 << 14])
def test_divergence(spark, chunk):
    rng = random.Random(3)
    words = ["the", "The", "Öl", "öl", "łód", "a1b", "x" * 3000, "z", "𝒜", "�", "q", "ß"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None])) for _ in range(150)]
    rows += [(None, "en", "none"), ("", "xx", "p"), ("1 2", "xx", "q"), ("word " * 20_000, "en", "long")] + [("same same", "yy", s) for s in "uvw"] * 4
    got = audit(table(spark, rows), min_docs=4, chunk_terms=chunk)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergences(rows, 4)


def test_divergence_of_nothing(spark):
    assert audit(table(spark, [])).count() == 0
    assert audit(table(spark, [("few words", "en", "only")])).count() == 0


def test_shares_past_64_bits():
    n, total = 3 * 10**14, 8 * 10**14
    assert shares(np.array([n, 0]), total, 7).tolist() == [1 + 10**9 * (n + 2) // (total + 14), 1 + 10**9 * 2 // (total + 14)]


def collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for t, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(t)):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in found.items()):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("bits", "top"), [(1 << 28, 2000), (64, 9)])
def test_collocations(spark, bits, top):
    rng = random.Random(5)
    words = ["a", "A", "bé", "c", "d'e", "\xa0", "łą", "𝒜", "e"] + [f"r{i}" for i in range(30)]
    fixed = ["in the long run", "long run", "on the other hand"]
    rows = []
    for _ in range(200):
        text = "".join(rng.choice([*words[:8], *fixed, rng.choice(words)]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "?"]) for _ in range(rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "en", "de", None]), "s"))
    rows += [(None, "en", "s"), ("", "fr", "s"), ("over and over " * 5000, "es", "s")] + [("tie one. tie two", "it", "s")] * 6
    got = mine(table(spark, rows), least=5, top=top, max_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == collocations(rows, 5, top)


def test_collocations_of_nothing(spark):
    assert mine(table(spark, [])).count() == 0
    assert mine(table(spark, [(None, None, None), ("rare words", "en", "s")])).count() == 0


def test_automaton_states_hold_every_run():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 12))).encode() for _ in range(60)]
    words = Words(texts, WORDS)
    automaton, terms = Automaton(words.ids, words.piece, 4), words.terms.to_pylist()
    for k in range(1, 5):
        want = Counter(tuple(ws[i : i + k]) for t in texts for ws in [t.split()] for i in range(len(ws) - k + 1))
        starts, counts = automaton.runs(k)
        got = {tuple(terms[i] for i in words.ids[s : s + k]): c for s, c in zip(starts, counts.tolist(), strict=True)}
        assert len(starts) == len(got) and got == want
    assert not all(longest.all() for longest in automaton.longest)  # some states hold several lengths


def test_filter_forgets_nothing():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    bits = np.zeros(64, np.uint64)
    for p in Filter.places(hashes, np.uint64(64 * 64 - 1)):
        np.bitwise_or.at(bits, (p >> np.uint64(6)).astype(int), np.uint64(1) << (p & np.uint64(63)))
    assert Filter(bits)(hashes).all()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first string, salt string")


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_warc_round_trip(spark, tmp_path, broadcast_rows):
    big = "<p>" + "x\r\n\r\n" * 400
    html = ["", None, "short", "short", big, big, big, "é" * 700, "\r\n" * 600, "WARC/1.1\r\n\r\n" * 200, "y" * 3_000_000, "é" * 700, "𝒜\r\n\r"]
    rows = [(i, f"http://x/{i}\r\n" if i % 3 else None, h, "a", "b", "c") for i, h in enumerate(html)]
    rows += [(None, "u", big, "", "", ""), (4, "again", big, "", "", ""), (6, "again", big, "", "", ""), (None, None, None, None, None, None)]
    warc.write_archives(pages(spark, rows).repartition(3), f"{tmp_path}/streams", broadcast_rows=broadcast_rows)
    index = warc.normalise(spark, f"{tmp_path}/streams", f"{tmp_path}/members")
    got = warc.read_back(index, task_bytes=500).collect()
    largest = {}
    for i, _, h, *_ in rows:
        if len((h or "").encode()) >= 1000:
            largest[h] = max(largest.get(h, -1), -1 if i is None else i)
    want = []
    for i, u, h, *_ in rows:
        raw = (h or "").encode()
        first = largest.get(h)
        again = first is not None and first != i
        url = u.replace("\r", "%0D").replace("\n", "%0A") if u else None
        want.append((str(i) if i is not None else None, url, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", str(first) if again else None, None if again else raw))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((*r[:6], bytes(r[6]) if r[6] is not None else None) for r in map(tuple, got)), key=key) == sorted(want, key=key)
    for r in index.collect():  # each record is a member of its own, and the members one after the other are the whole file
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\nWARC-Type: " + r.type.encode())
    whole = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "members").glob("*.warc.gz")))
    assert whole.count(b"WARC-Record-ID") == len(rows)


def test_warc_of_nothing_and_of_damage(spark, tmp_path):
    warc.write_archives(pages(spark, []), f"{tmp_path}/none")
    index = warc.normalise(spark, f"{tmp_path}/none", f"{tmp_path}/none-members")
    assert index.count() == 0 and warc.read_back(index).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")[:-9])
    with pytest.raises(Exception, match="ends"):
        warc.normalise(spark, f"{tmp_path}/bad", f"{tmp_path}/bad-members")
    assert not list((tmp_path / "bad-members").glob("*.warc.gz"))


def test_warc_of_several_members(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = lambda i: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: 3\r\n\r\nab{i}\r\n\r\n".encode()
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(one(1) + one(2)[:30]) + gzip.compress(one(2)[30:]) + gzip.compress(b""))
    index = warc.normalise(spark, f"{tmp_path}/in", f"{tmp_path}/out").orderBy("offset").collect()
    assert [r.record_id for r in index] == ["<urn:x:1>", "<urn:x:2>"]
    data = (tmp_path / "out" / "a.warc.gz").read_bytes()
    assert [gzip.decompress(data[r.offset : r.offset + r.length]) for r in index] == [one(1), one(2)]
