"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from taktwerk.llm import chat, langid, secrets
from taktwerk.llm.bpe import WordBpe, bpe_encode
from taktwerk.llm.components import connected_components
from taktwerk.llm.decontaminate import decontaminate, words_of
from taktwerk.llm.embeddings import near_vectors
from taktwerk.llm.html import extract, extract_text
from taktwerk.llm.passages import repeated_passages, without_passages
from taktwerk.llm.queries import vocabulary_path
from taktwerk.llm.sharding import shard
from taktwerk.llm.simhash import fingerprint, simhash_components
from taktwerk.llm.units import repeated_units, without_units

DOCS = "doc_id long, text string, lang string, fp string, n_words string"


def docs(spark, *texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "clash", "clash") for i, t in enumerate(texts)], DOCS)


def joined(parent):
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    return root


def test_components_of_a_path_a_star_and_null(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(None, 5), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_decontamination(spark, chunk):
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 6, n)]
    items = [(str(i), " ".join(word(int(rng.integers(1, 30))))) for i in range(12)] + [("e", ""), ("n", None), ("0", "w1 W2")]
    texts = [" ".join(word(int(n))) for n in rng.integers(0, 300, 25)] + [None, "", "?!", "É w1-w2 " * 3]
    table = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate(docs(spark, *texts), table, ["doc_id", "n_words"], chunk_bytes=chunk, clean=True).orderBy("doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        words, hit, ids = words_of((text or "").encode()), set(), set()
        for i, t in items:
            own = words_of((t or "").encode())
            k = min(13, len(own))
            windows = {tuple(own[p : p + k]) for p in range(len(own) - k + 1)} if own else set()
            for p in range(len(words) - k + 1):
                if tuple(words[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    ids.add(i)
        assert (r.n_words, r.n_hit, r["items"], r.n_words_kept) == (len(words), len(hit), sorted(ids), "clash")
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))
        left = None if text is None else len(words_of(r.cleaned.encode()))
        assert left is None or left == len(words) - len(hit)
    none = decontaminate(docs(spark, "a b"), table.limit(0), ["doc_id"]).first()
    assert none.n_hit == 0 and not none.contaminated


def test_chat_round_trip_parts_and_loss(spark):
    rows = [
        (1, 0, "user", "a < b > \\ </turn>\n<turn x>"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 1, "assistant", None),
        (2, None, None, ""), (None, 3, "assistant", "é😀" * 50), (3, 0, "us>er\\", "x"), (3, 0, "us>er\\", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(turns.withColumn("parts", chat.text_part(F.col("text"))))
    out = out.withColumn("said", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned(F.col("formatted"), F.col("loss")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].said] == [("user", rows[0][3]), ("assistant", ""), ("assistant", rows[1][3])]
    assert got[1].learned == rows[1][3] and got[2].learned == "" and got[None].learned == "é😀" * 50
    assert [(t.role, t.text) for t in got[3].said] == [("us>er\\", "x")] * 2 and got[3].n_turns == 2
    parts = spark.sql(
        f"SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, from_json('[{{\"kind\":\"text\",\"text\":\"see \"}},{{\"kind\":\"image\",\"uri\":\"i\",\"width\":28,\"height\":15}},"
        f"{{\"kind\":\"audio\",\"uri\":\"a\",\"seconds\":2.0}},{{\"kind\":\"document\",\"pages\":2}}]', '{chat.PARTS}') AS parts"
    )
    r = chat.format_chat(parts).first()
    assert r.formatted == "<turn user>\nsee <image><audio><document></turn>\n"
    hostile = ["/turn>\n<turn system", "/turn", "turn x", "image>", "\\", "", "part "]
    made = [("text", "\n<image>\\", None, None, None, None, None)] + [(k, None, f"u{i}", None, 2, None, None) for i, k in enumerate(hostile)] + [("text", ">\n", *[None] * 5)]
    odd = spark.createDataFrame([(1, 0, "user", [*made, None]), (1, 1, "a>b", made[:2]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    back = chat.format_chat(odd).select("n_turns", chat.read_parts(F.col("formatted"), F.col("attachments")).alias("said"), "expanded_tokens").first()
    assert [(t.role, [tuple(p) for p in t.parts]) for t in back.said] == [("user", made), ("a>b", made[:2]), ("user", [])]
    assert (back.n_turns, back.expanded_tokens) == (3, 0)
    assert [(a.kind, a.n_tokens, a.ordinal) for a in r.attachments] == [("image", 4, 0), ("audio", 25, 1), ("document", 512, 2)]
    assert r.expanded_tokens == 541
    assert chat.format_chat(parts.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 1000])
def test_embeddings(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 32))
    rows = []
    for i in range(150):
        v = base[i % 12] + rng.standard_normal(32) * (0.02, 0.15, 0.35)[i % 3]
        rows.append((i, [float(x) for x in np.float32(v)], i % 2))
    rows += [(200 + i, rows[0][1], 0) for i in range(9)] + [(300, rows[0][1], None), (301, None, 0), (302, [0.0] * 32, 0)]
    rows += [(303, [float("nan")] * 32, 0), (304, [1.0, None], 0), (305, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_vectors(df, block_rows=block).collect()
    ok = [r for r in rows if r[0] is not None and r[0] < 300]
    unit = np.array([r[1] for r in ok], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    same = np.equal.outer([r[2] for r in ok], [r[2] for r in ok])
    link = (unit @ unit.T >= 0.98) & same
    np.fill_diagonal(link, False)
    parent = {r[0]: r[0] for r in rows}
    root = joined(parent)
    for a, b in zip(*np.nonzero(link), strict=True):
        x, y = root(ok[a][0]), root(ok[b][0])
        parent[max(x, y)] = min(x, y)
    want = {r[0]: (int(n), root(r[0])) for r, n in zip(ok, link.sum(1), strict=True)}
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None:
            n, c = want.get(r.vec_id, (0, r.vec_id))
            assert (r.n_links, r.component_id, r.kept) == (n, c, c == r.vec_id), r
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
    assert near_vectors(df.limit(0)).count() == 0


def test_simhash(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 500, 300)]
        texts.append(" ".join(words))
        for _ in range(3):
            words[int(rng.integers(300))] = "changed"
            texts.append(" ".join(words))
    texts += [None, "", "one two", "ONE\ttwo", " \n"]
    df = docs(spark, *texts)
    got = {r.doc_id: r for r in simhash_components(df.union(df)).collect()}
    prints = [fingerprint((t or "").encode()) for t in texts]
    parent = {i: i for i in range(len(texts))}
    root = joined(parent)
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in range(len(texts))}
    assert len({root(i) for i in range(160)}) < 160 and simhash_components(df.limit(0)).count() == 0
    from taktwerk.llm.simhash import similar_prints

    near = [int(np.uint64(p).view(np.int64)) for p in [1 << i for i in range(40)]]
    edges = similar_prints(spark.createDataFrame([(p,) for p in near], "fp long"), block_rows=3)
    assert connected_components(edges).select("component").distinct().count() == 1


def test_language(spark):
    texts = ["the house and the garden", "der garten und das haus", "the end", "und das ende", None, "", "12 ?", "hausgarten", "日本"] * 3
    rows = [(i, t, ("en", "de", "en", "de")[i % 9] if i % 9 < 4 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = [(r.lang_pred, r.score) for r in langid.identify(df, ["doc_id"], model).orderBy("doc_id").collect()]
    assert [x for x, _ in got[:8]] == ["en", "de", "en", "de", "und", "und", "und", "de"]
    assert got[8][0] in ("en", "de") and all(0 <= s <= 1 for _, s in got) and got[0] == got[9]
    assert langid.identify(df, ["doc_id"], langid.train(df.limit(0))).first().lang_pred == "und"


def test_language_equals_a_brute_force_of_dictionaries(spark):
    import math
    from collections import Counter

    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    letters = {"a": "abcdeé", "b": "cdefgh", "c": "日本語ßab"}
    text = lambda k: " ".join(word(letters[k]) for _ in range(rng.randint(1, 60))) + rng.choice([".", " 12x_y", "\n"])
    rows = [(text(k), k) for k in "abcaab" * 12]
    model = langid.train(spark.createDataFrame([*rows, rows[0], (None, "a"), ("x", None)], "text string, lang string"))
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = [{k: Counter() for k in letters} for _ in range(6)]
    for t, k in set(rows):
        for w in words(t):
            counts[0][k][w] += 1
            for n in range(1, 6):
                counts[n][k].update(g for g in grams(w, n) if n > 1 or g not in "^$")
    log = lambda n, g, k: math.log((counts[n][k][g] + 0.5) / (sum(counts[n][k].values()) + 0.5 * (len(set().union(*counts[n].values())) + 1)))
    for t in [*(t for t, _ in rows[:20]), *(text(k) for k in "abc" * 10), "ÉÉ", "zz", "12", ""]:
        total = {k: math.log((sum(x == k for _, x in set(rows)) + 1) / (len(set(rows)) + 3)) for k in letters}
        for w in words(t):
            for n in (0, 5, 4, 3, 2, 1):
                found = [g for g in ([w] if n == 0 else grams(w, n)) if any(g in counts[n][k] for k in letters) and (n != 1 or g not in "^$")]
                if found:
                    for k in letters:
                        total[k] += sum(log(n, g, k) for g in found) / len(found)
                    break
        best = max(sorted(total), key=total.get)
        lang, share = model.predict(t)
        if not any(c.isalpha() for c in t):
            assert (lang, share) == ("und", 0.0)
        else:
            assert lang == best and share == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), abs=1e-4)


def test_language_held_out_accuracy_and_odd_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clash = table.select("doc_id", "text", "lang", langid.held_out().alias("held_out"), F.lit("clash").alias("score"))
    got = langid.identify(clash, ["lang", "held_out", "score"], langid.fit_on_documents(table)).filter("held_out AND lang IS NOT NULL AND lang_pred != 'und'")
    right = [r.lang == r.lang_pred for r in got.collect()]
    assert len(right) > 250 and np.mean(right) > 0.98
    assert "score_kept" in got.columns
    assert langid.identify(table.limit(0), ["doc_id"], langid.train(table.limit(0))).count() == 0


def test_language_fit_has_rare_languages_and_counts_copies_once(spark):
    rows = [(f"the house number{i} and the garden", "en") for i in range(400)] + [("talo ja puutarha", "fi"), ("talo on suuri", "fi")]
    rows += [("ein und dasselbe", "de")] * 300 + [(f"der garten nummer{i} und das haus", "de") for i in range(100)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), max_docs=50)
    assert model.langs == ["de", "en", "fi"] and model.predict("suuri talo")[0] == "fi"
    assert np.allclose(np.exp(model.prior), np.array([102, 401, 3]) / 506)
    assert model.predict("der garten und das haus")[0] == "de"


def test_sharding(spark):
    texts = ["x" * (i % 50) for i in range(300)] + [None, "y" * 900]
    df = docs(spark, *texts)
    got = shard(df.union(df.limit(1)), ["doc_id"], max_bytes=500).collect()
    assert len(got) == 303
    sizes: dict[str, int] = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
        assert len(r.shard) == r.shard_depth
        assert not any(r.shard != s and r.shard.startswith(s) for s in sizes)
    assert all(v <= 500 for s, v in sizes.items() if not any(r.shard == s and r.n_bytes == 900 for r in got))
    for s in sizes:  # no bucket split that fitted: a shard and its sibling together exceed the limit
        assert sum(v for t, v in sizes.items() if t.startswith(s[:-1])) > 500
    assert {r.fits for r in got} == {True, False}
    assert shard(df, ["doc_id"]).select("shard").distinct().collect()[0].shard == "all"
    assert shard(df.limit(0), ["doc_id"]).count() == 0
    clash = df.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("n_bytes", "depth", "prefix", "fits", "shard", "hash", "row")))
    out = shard(clash, clash.columns, max_bytes=500)
    assert out.count() == 302 and {"n_bytes_kept", "depth", "prefix", "fits_kept", "shard_kept", "hash", "row"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    null_ids = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.shard == "all", r.fits) for r in shard(null_ids, [], max_bytes=500).select("shard", "fits").distinct().collect()] == [(True, False)]


def test_bpe_equals_the_library_at_every_code_point():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path := vocabulary_path())
    tok.no_truncation(), tok.no_padding()
    bpe = WordBpe(path)
    points = [*range(0xD800), *range(0xE000, 0x34000), *range(0x3D000, 0x3D010), *range(0xE0000, 0xE0200)]
    for i in range(0, len(points), 20_000):
        texts = [f"ab{chr(c)}ba 7{chr(c)}{chr(c)}" for c in points[i : i + 20_000]]
        want = [" ".join(map(str, e.ids)) for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert [bpe.encode(t)[1] for t in texts] == want


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    tok = Tokenizer.from_file(path)
    texts = [None, "", "Don't  STOP\t\n<|endoftext|>now ½²K", "ΑΣ ΟΔΟΣ é́ 日本語 😀\x1c\x85", "a" * 3000, "wörd " * 500, "'s'T <|startoftext|"]
    got = bpe_encode(docs(spark, *texts), ["doc_id"], path).orderBy("doc_id").collect()
    bpe = WordBpe(path)
    for t, r in zip(texts, got, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids)
        assert r.decoded == tok.decode(ids, skip_special_tokens=False) == bpe.decode(r.ids)


def test_secrets(spark):
    rng = np.random.default_rng(4)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    texts = [f'word Token = "{key()}" and more words' for _ in range(60)]
    texts += [None, "", "token: token: abcdefgh", "api_key=abc", "APIKEY='abcdef' AKIA" + "A" * 16, "AKIAX", "ſecret=abcdefg", "é" + "0" * 24]
    texts += [f"x {key()[:20]} y", "averyveryverylongordinaryword " * 3]
    df = docs(spark, *texts)
    got = secrets.scan(df, ["doc_id"], secrets.fit(df)).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        want = []
        for k, pattern, least in ((0, secrets.ASSIGN, 6), (1, re.compile("AKIA[A-Z0-9]+"), 20), (2, re.compile("[0-9a-f]+"), 24)):
            want += [(m.start(), k, m.end()) for m in pattern.finditer(t or "") if len(m[2] if k == 0 else m[0]) >= least]
        assert [(b.kind, b.start, b.end) for b in r.base] == [(secrets.KINDS[k], s, e) for s, k, e in sorted(want)]
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert [len(r.base) for r in got[60:68]] == [0, 0, 0, 0, 2, 0, 0, 1]
    assert not got[-1].spans
    red = secrets.scan(df, ["text"], secrets.fit(df)).select("text", secrets.redacted("text", "spans").alias("red"))
    assert all("Token" not in r.red and r.red.endswith("and more words") for r in red.collect() if r.text and r.text.startswith("word T"))
    assert sum(x.kind == secrets.LEARNED for r in got for x in r.spans) >= 60  # the labelled values, scored like all candidates
    empty = secrets.fit(df.limit(0))
    assert not empty.grammars and secrets.scan(df, ["doc_id"], empty).count() == len(texts)


def test_grammar_keeps_lengths_and_prefixes():
    rng = np.random.default_rng(5)
    made = lambda letters, n: "".join(rng.choice(list(letters), n))
    model = secrets.Grammar([made("0123456789abcdef", 40) for _ in range(200)])
    assert len(model.states) == 41
    # a likely run is one of its length and letters; each way of missing that costs bits
    good = model.score(made("0123456789abcdef", 40))
    assert good > -4 * 40 - 8 and all(model.score(x) < -4 * len(x) - 8 for x in ("0f" * 19, "0f" * 22, "0f" * 19 + "zz", "deadbeefab"))
    key = secrets.Grammar(["AKIA" + made("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16) for _ in range(100)])
    assert key.score("AKIA" + "X7" * 8) > key.score("BKIA" + "X7" * 8) + 4
    # no fixed length: states merge into a loop
    assert len(secrets.Grammar(["ab" * int(n) for n in rng.geometric(0.2, 300)]).states) < 12
    texts = ["x " + made(secrets.LETTERS[:62], int(n)) for n in (3, 40, 40, 700)] + ["AKIA" + made("ABC", 16) + ".", "-" * 9, "", "a=" * 9, "abc=== .key-.", "ü" * 50]
    shared = secrets.FormatModel({"key": ["AKIA" + made("ABCDEFG0123456789", 16) for _ in range(50)]}, {"ab": 5, " a": 3, "b ": 3})
    for text, (found, best) in zip(texts, shared.scan(texts), strict=True):
        want, (g,) = [], shared.grammars.values()
        for m in re.finditer(r"[A-Za-z0-9+/_.-]+={0,2}", text):  # brute force: each candidate on its own
            run = m[0].lstrip(".-")
            run = run if run.endswith("=") else run.rstrip(".-")
            if len(run.rstrip("=")) and len(run) >= g.shortest:
                signs = [secrets.BORDER, *map(secrets.LETTERS.index, run), secrets.BORDER]
                plain = sum(float(shared.pairs[a, b]) for a, b in zip(signs, signs[1:], strict=False))
                want.append((m.start() + m[0].index(run), run, g.score(run) - plain))
        assert found == [(s, s + len(r)) for s, r, bits in want if bits > 20]
        assert best == (pytest.approx(max(x for *_, x in want), abs=1e-2) if want else None)


def test_a_labelled_format_is_found_where_no_pattern_finds_it(spark):
    rng = np.random.default_rng(6)
    made = lambda: "sk_live_" + "".join(rng.choice(list(secrets.LETTERS[:62]), 24))
    words = ["".join(rng.choice(list("etaoinshrdlucmwfgypbvk"), int(n))) for n in rng.integers(2, 12, 4000)]
    words = [(w, w.title(), w.upper(), str(int(rng.integers(10**9))))[int(k)] for w, k in zip(words, rng.choice(4, 4000, p=[0.8, 0.12, 0.04, 0.04]), strict=True)]
    prose = lambda i: " ".join(words[i * 20 : i * 20 + 20])
    labelled = [f"{prose(i)} secret: {made()} {prose(i + 1)}" for i in range(60)]
    bare = [f"{prose(i)} {made()}. {prose(i + 1)}" for i in range(60, 160)]
    df = docs(spark, *labelled, *bare, *(prose(i) for i in range(160, 200)))
    got = secrets.scan(df, ["doc_id"], secrets.fit(df)).orderBy("doc_id").collect()
    found = [[x for x in r.spans if x.kind == secrets.LEARNED] for r in got]
    exact = sum([bare[i][x.start : x.end] for x in f] == [bare[i].split("sk_")[1].split(".")[0].join(["sk_", ""])] for i, f in enumerate(found[60:160]))
    assert exact >= 90 and not any(r.base for r in got[60:]) and not any(found[160:])
    wide = docs(spark, f"x svc_{'0123456789abcdef' * 2}_tail y")
    assert secrets.scan(wide, ["text"], secrets.fit(df)).select(secrets.redacted("text", "spans")).first()[0].startswith("x ")


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><a href=x>Menu</a></nav><header>Top</header>"
        "<div class='cookie-notice'><p>We use cookies, many, many.</p></div><article><h1>Head&amp;line</h1><p>One,\n two &lt;b&gt; <b>three"
        "<p>Four&nbsp;five<br>six<ul><li>a<li>b</ul><form><p>mail</p></form><!-- <p>no</p> --></article>"
        "<section id=comments><p>First, nice, really, nice, post, thanks, all.</p></section><footer>(c)</footer>"
    )
    assert extract(page) == "Head&line\n\nOne, two <b> three\n\nFour five six\n\na\n\nb"
    pages = spark.createDataFrame([(1, "u", page, "clash"), (2, None, None, ""), (3, "u", "", ""), (4, "u", "<p>" * 3000 + "deep", "")], "page_id long, url string, html string, text string")
    got = extract_text(pages.union(pages), ["page_id", "url"]).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [len(extract(page))] * 2 + [0] * 4 + [4] * 2
    assert extract("a < b") == "a < b" and extract("<div>" * 5000 + "x") == "x"


PROSE = "<p>A long paragraph, with commas, clauses, and more than enough words to be taken for text of an article.</p>" * 4
PLAIN = "\n\n".join(["A long paragraph, with commas, clauses, and more than enough words to be taken for text of an article."] * 4)


@pytest.mark.parametrize("name", ["content has-sidebar", "post comments-open", "elementor-widget widget", "main-content", "page no-footer"])
def test_html_wrappers_with_ordinary_names_keep_the_article(name):
    page = f"<body><nav><a href=x>Home</a></nav><div class='{name}'><h1>Title</h1>{PROSE}</div><div class=footer>Foot</div></body>"
    assert extract(page) == "Title\n\n" + PLAIN
    assert extract(page.replace("div", "section")) == "Title\n\n" + PLAIN


@pytest.mark.parametrize("outer", ["div", "body"])
def test_html_keeps_everything_of_the_article(outer):
    more = "<section><h2 id=search-algorithms>Note</h2><p>Short.</p></section><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>bare text<div>The end.</div>"
    drop = "<ul class=menu><li><a href=x>Menu</a></ul><div><a href=a>One</a> <a href=b>Two</a></div><div>© 2024 Someone</div><div class='related-posts'><p>Other, things.</p></div>"
    want = "\n\n".join([PLAIN, "Note", "Short.", "one", "two", "a", "b", "bare text", "The end."])
    assert extract(f"<{outer}><section>{PROSE}</section>{more}{drop}</{outer}>") == want
    ids = f"<article><header><h1>T</h1><p>By X</p></header>{PROSE}<section id='related-work'><h3 id=share-prices>R</h3><p>x</p></section><footer>f</footer></article>"
    assert extract(ids) == "\n\n".join(["T", PLAIN, "R", "x"])


@pytest.mark.parametrize("name", ["comments", "comment-list", "post-comments", "disqus_thread", "sidebar", "left-sidebar", "newsletter-form", "cookie-notice", "ad", "share-links"])
def test_html_drops_what_a_name_marks(name):
    talk = f"<div class='{name}'>" + "<article class=comment><p>Nice, really, great, post.</p></article>" * 30 + "</div>"
    assert extract(f"<body><div><h1>T</h1>{PROSE}</div>{talk}</body>") == "T\n\n" + PLAIN
    assert extract(f"<main>{PROSE}{talk}</main>") == PLAIN


def test_html_takes_linear_time_on_hostile_pages():
    import time

    n = 100_000
    pages = ["<div><p>" * n + "x", "<a b=\"" * n + "x", "<a '\">" * n, "<b>" * n + "</i>" * n, "<b>" * 400 + "<h2>a</h2>" * n, "<p><b>" * n, "<textarea>" * n, "<" * n, "<a " * n + ">"]
    for page in pages:
        start = time.process_time()
        extract(page)
        assert time.process_time() - start < 4, page[:20]
    assert extract("<div>" * n + "deep" + "</div>" * n) == "deep"


def test_html_equals_the_standard_parser_on_the_given_pages(spark):
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.blocks[-1] += " " if tag == "br" else ""
            if tag in ("p", "h1"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"

        def handle_data(self, data):
            self.blocks[-1] += data if self.inside else ""

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    clash = pages.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = extract_text(clash, ["page_id", "html", "text", "n_chars"]).collect()
    assert len(got) == pages.count() and {(r.text_kept, r.n_chars_kept) for r in got} == {("clash", "clash")}
    for r in got:
        reader = Reader()
        reader.feed(r.html or "")
        assert r.text == "\n\n".join(x for b in reader.blocks if (x := " ".join(b.split()))) and r.n_chars == len(r.text)
    assert extract_text(pages.limit(0), ["page_id"]).count() == 0


def test_units(spark):
    line, other = "This line has five words", "another line of five words"
    texts = [f"{line}\nshort\n{other}", f"first\n  this LINE has\tfive words", f"{line}\n{line}\nend of it all here", None, "", "short\nshort"]
    df = docs(spark, *texts)
    removed = repeated_units(df)
    got = sorted((r.doc_id, r.unit_no, texts[r.doc_id][r.start : r.end], r.kept_doc_id, r.kept_unit_no) for r in removed.collect())
    assert got == [(1, 1, "  this LINE has\tfive words", 0, 0), (2, 0, line, 0, 0), (2, 1, line, 0, 0)]
    left = {r.doc_id: r.text for r in without_units(df, removed).collect()}
    assert left == {0: texts[0], 1: "first\n", 2: "end of it all here", 3: None, 4: "", 5: "short\nshort"}
    assert repeated_units(df.union(df)).distinct().count() == 3 and repeated_units(df.limit(0)).count() == 0
    null_ids = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.kept_doc_id for r in repeated_units(df.union(null_ids)).collect()} == {0, 2}


def removed_words(texts, size):
    """Brute force: of each text, the words of every run of `size` words that stands earlier too."""
    first, gone = {}, [set() for _ in texts]
    for d, text in enumerate(texts):
        w = re.findall("[\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff]|[^\\s\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff]+", text or "")
        w = [x.translate(str.maketrans({c: c + 32 for c in range(65, 91)})) for x in w]
        for i in range(len(w) - size + 1):
            at = first.setdefault(tuple(w[i : i + size]), (d, i))
            if at != (d, i):
                gone[d] |= set(range(max(i, at[1] + size) if at[0] == d else i, i + size))
    return gone


@pytest.mark.parametrize("rows", [1, 4096])
def test_passages(spark, rows):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzABC") * rng.randint(1, 3)
    text = lambda n: [word() for _ in range(n)]
    shared, chinese = text(70), "".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(80))
    texts = [
        " ".join(text(30) + shared + text(20)),
        " ".join(text(9)) + "\n" + "\n ".join(shared[:60]) + ", " + " ".join(text(40)),  # other line breaks, mid-sentence
        " ".join(text(80) + shared[10:61]).upper(),
        " ".join(shared[:50]),  # a word too short
        chinese,
        "x " + chinese[15:] + " y",
        "la " * 200,
        " ".join(text(7) * 12),
        " ".join(text(60) + shared[5:70] + shared),
        None,
        "",
    ]
    got = [set() for _ in texts]
    removed = repeated_passages(docs(spark, *texts), anchor_rows=rows)
    for r in removed.collect():
        part = texts[r.doc_id][r.start : r.end]
        assert r.n_words >= 1 and part.strip() and not got[r.doc_id] & set(range(r.unit_no, r.unit_no + r.n_words))
        got[r.doc_id] |= set(range(r.unit_no, r.unit_no + r.n_words))
    want = removed_words(texts, 51)
    assert got == want and all(want[i] for i in (1, 2, 5, 6, 7, 8)) and not any(want[i] for i in (0, 3, 4))
    cut = {r.doc_id: r.text for r in without_passages(docs(spark, *texts), removed).collect()}
    assert cut[5] == "x  y" and cut[0] == texts[0] and len(cut[6].split()) == 51
    more = docs(spark, *texts[:2]).withColumn("doc_id", F.lit(None).cast("long"))
    null_ids = repeated_passages(docs(spark, *texts).union(docs(spark, *texts)).union(more).union(more), anchor_rows=rows).collect()
    assert {r.n_words for r in null_ids if r.doc_id is None} == {len(texts[0].split()), len(texts[1].split())} and len(null_ids) == removed.count() + 2
    assert repeated_passages(docs(spark)).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    out = corpus_pipeline.run(spark, sf)
    docs_in = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r for r in out.collect()}
    und = {r.doc_id for r in langid.identify(docs_in, ["doc_id"], langid.fit_on_documents(docs_in)).filter("lang_pred = 'und' OR score < 0.5").collect()}
    first = docs_in.filter(~F.col("doc_id").isin(list(und)))
    parts = {r.doc_id: r.component_id for r in simhash_components(first).collect()}
    second = first.filter(F.col("doc_id").isin([d for d, c in parts.items() if d == c]))
    dirty = {r.doc_id for r in decontaminate(second, spark.read.parquet(f"{sf}/benchmark.parquet"), ["doc_id"]).filter("contaminated").collect()}
    third = second.filter(~F.col("doc_id").isin(list(dirty)))
    assert set(kept) == {r.doc_id for r in third.collect()}
    tok = Tokenizer.from_file(vocabulary_path())
    spans = {r.doc_id: r for r in secrets.scan(third, ["doc_id", "text"], secrets.fit(third)).collect()}
    assert any(r.spans for r in spans.values())
    for doc, r in kept.items():
        text = list(spans[doc].text or "")
        covered = sorted({i for x in spans[doc].spans for i in range(x.start, x.end)}, reverse=True)
        for i in covered:
            text[i : i + 1] = [] if i - 1 in covered else ["[secret]"]
        ids = tok.encode("".join(text), add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids) and r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, base string, fp string, n_words int"
    rows = [(None, None, None, None, None, "b", "f", 1), (None, "the house and the garden", None, "s", 9, "b", "f", 1), (3, "", "en", None, None, "b", "f", 1)]
    rows += [(i, f"the house and the garden number {i} of many more", "en", "s", 5, "b", "f", 1) for i in range(4, 20)] * 2
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "/root/testdata/sf0.001")
            assert not df.count() or set(df.columns) - {"text"} <= set(out.columns)
            df = out
        assert df.count() in (0, 33)
