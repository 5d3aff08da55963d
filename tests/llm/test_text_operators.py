"""Text operators against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlark.llm import chat, decontam, licenses, ngram_join, pii, quality, sharding
from gridlark.llm.components import components

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
CLASH = "doc_id long, text string, n_words long, kept boolean, shard int, slot string, tokens long, p string, class long, x string, s int, label string, spans string"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 1, True, 2, "z", 3, "q", 4, "x", 5, "l", "sp") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["É", "ñandú", "A", "the", "\x0b", "x" * 300]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 90))) for _ in range(30)]
    out = [None, "", " \n\t ", "one", "one", "ONE", "a b c d", "a b c d e", *base]
    for t in base[:12]:
        w = t.split(" ")
        for _ in range(3):
            w2 = list(w)
            for _ in range(max(1, len(w) // 30)):
                w2[rnd.randrange(len(w2))] = rnd.choice(words)
            out.append(" ".join(w2))
    out += base[:3]
    out.append("long " * 30000)
    out.append(" ".join(f"u{i}" for i in range(20000)))
    return out


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def jaccard_brute(rows):
    sets = []
    for _, t in rows:
        w = space_words((t or "").translate(LOW))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("leaf,first,later", [(256, 4, 32), (2, 1, 2)])
def test_jaccard(spark, texts, monkeypatch, leaf, first, later):
    monkeypatch.setattr(ngram_join, "FIRST_PIVOTS", first)
    monkeypatch.setattr(ngram_join, "PIVOTS", later)
    monkeypatch.setattr(ngram_join, "PART", 3 if later == 2 else ngram_join.PART)
    got = ngram_join.jaccard_classes(docs(spark, texts), leaf=leaf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_brute(list(enumerate(texts)))
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(tuple(space_words((t or "").translate(LOW))), i)
    assert all(r.class_id <= r.doc_id for r in got)


def test_jaccard_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "a b c d e f"), (1, "a b c d e f")]
    got = ngram_join.jaccard_classes(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_jaccard_empty(spark):
    assert ngram_join.jaccard_classes(docs(spark, [])).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: root(n) for n in parent}


def test_quality(spark, texts):
    more = [*texts, "a a a a " * 30, "same line\nsame line\n \nsame line\nother " * 9, "ok| " * 80, " ".join(f"{i} 1{i}" if i % 5 else f"w{i}" for i in range(90)), " ".join(["aa bb cc dd ee ff gg hh ii jj"] * 6 + [f"x{i}" for i in range(80)]), " ".join("z" * (9 + i % 7) + str(i) for i in range(70))]
    got = {r.doc_id: r for r in quality.judged(docs(spark, more), ["doc_id"], measured=True).collect()}
    for i, t in enumerate(more):
        w = space_words(t)
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        count = {g: tri.count(g) for g in set(tri)} if len(tri) < 3000 else {g: (len(tri) if len(set(tri)) == 1 else 1) for g in set(tri)}
        hit = {j + k for j, g in enumerate(tri) if count[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if space_words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)), i
        n = len(w)
        lettered = sum(any(c.isalpha() or ord(c) > 127 for c in x) for x in w)
        top = max((t.count(c) for c in set(t)), default=0) if t else 0
        bad = 100 * lettered < 40 * n or 100 * len(set(w)) < 5 * n or 100 * top > 50 * len(t or "") or n < 50 or 100 * len(hit) > 50 * n or 100 * r.n_symbols > 20 * n or 100 * r.n_dup_lines > 50 * len(lines) or r.word_chars < 2 * n or r.word_chars > 20 * n
        assert r.kept == (not bad) and (r.rejected_by is None) == r.kept
    for sample in (1, 7):  # most documents go through the cascade
        fast = {r.doc_id: r.kept for r in quality.judged(docs(spark, more), ["doc_id"], sample_rows=sample).collect()}
        assert fast == {i: r.kept for i, r in got.items()}
    assert quality.judged(docs(spark, []), ["doc_id"]).count() == 0


def test_cascade_measures_no_more_than_it_needs(monkeypatch):
    """After the sample, a rule sees only what the rules before it left, cheapest rejections first."""
    seen = []

    def rule(name, of, wait):
        def rejects(m):
            time.sleep(wait)
            seen.append((name, len(m["n_words"])))
            return m["n_words"] % of == 0

        return quality.Rule(name, ("words",), rejects)

    rules = (rule("slow", 2, 0.02), rule("fast", 3, 0.0))
    texts = pa.array([" ".join("w" * (i + 1) for _ in range(i % 6 + 1)) for i in range(60)])
    got = list(quality._cascade(rules, 0, 0, False, 12)([pa.RecordBatch.from_arrays([texts], ["text"])]))
    assert [b.num_rows for b in got] == [12, 48] and seen == [("slow", 12), ("fast", 12), ("fast", 48), ("slow", 32)]
    assert got[1].column(1).to_pylist() == ["fast" if n % 3 == 0 else "slow" if n % 2 == 0 else None for n in (i % 6 + 1 for i in range(12, 60))]


def test_decontamination(spark):
    rnd = random.Random(3)
    w = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(w) for _ in range(rnd.choice([3, 13, 20])))) for i in range(12)] + [(50, None), (51, "..."), (None, "t1 t2 t3"), (7, "t1 t2")]
    texts = [None, "", "t1, T2;  t3"]
    for i in range(30):
        body = [rnd.choice(w) for _ in range(rnd.randrange(5, 80))]
        own = (rnd.choice(items[:12])[1] or "").upper().replace(" ", ", É".replace("É", ""))
        texts.append(" ".join(body[:20]) + " <" + own + "> " + "ñ ".join(body[20:]))
    texts += texts[5:7]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit, ids in ((decontam.ITEM_CHARS, ["doc_id"]), (200, ["doc_id"]), (200, ["text", "doc_id"])):
        got = {r.doc_id: r for r in decontam.benchmark_hits(docs(spark, texts), bench, ids, item_chars=limit).collect()}
        for i, t in enumerate(texts):
            dw, hit, own = alnum_words(t), set(), set()
            for item, x in items:
                iw = alnum_words(x)
                k = min(13, len(iw))
                if item is None or not k:
                    continue
                for a in range(len(iw) - k + 1):
                    for b in range(len(dw) - k + 1):
                        if dw[b : b + k] == iw[a : a + k]:
                            hit |= set(range(b, b + k))
                            own.add(item)
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(dw), len(hit), sorted(own))
            found = [alnum_words(t[s.start : s.end]) for s in got[i].spans]
            assert sum(map(len, found)) == len(hit)
    assert decontam.benchmark_hits(docs(spark, []), bench, ["doc_id"]).count() == 0


def test_licenses(spark):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit")
    texts = [None, "", "CC-BY cc by CC BY 4.0", "All rights, reserved. all rights all rights reserved", mit.upper(), "x " * 50 + mit.replace("granted", "hereby given") + " y", "the of and " * 5000, "licensed under cc by nc 4.0 licensed"]
    texts += [texts[2]]
    got = {r.doc_id: r for r in licenses.scanned(docs(spark, texts), ["doc_id"]).select("*", licenses.labels().alias("labels"), licenses.score().alias("score")).collect()}
    for i, t in enumerate(texts):
        w = alnum_words(t)
        hits = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, sorted({x for _, x in hits}))
        assert 0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels)
    assert got[4].labels == ["mit"] and got[5].labels == ["mit"] and got[6].labels == [] and "cc-by-nc-4.0" in got[7].labels
    assert licenses.scanned(docs(spark, []), ["doc_id"]).count() == 0


def test_whole_license_texts(spark, tmp_path):
    """Texts of a folder, whole and with every 20th word changed; a text within a larger one does not count; phrases of one word."""
    rnd = random.Random(8)
    body = [" ".join(rnd.choice("abcdefghijklmnop") + str(rnd.randrange(40)) for _ in range(n)) for n in (3000, 300)]
    (tmp_path / "ABC-2").write_text(body[0])
    (tmp_path / "ABC-2.1").write_text(body[0][: len(body[0]) // 2] + " " + body[1])
    whole = licenses.whole_texts(str(tmp_path))
    assert [label for label, _ in whole] == ["abc-2.0", "abc-2.1"] and licenses.whole_texts(str(tmp_path / "none")) == ()
    bsd = [t for label, t in licenses.TEMPLATES if label.startswith("bsd-")]
    edited = " ".join("new" if i % 20 == 9 else w for i, w in enumerate(body[0].split()))
    texts = [body[0], "Pre " + edited + " post", whole[1][1], bsd[0], bsd[1], body[0][: len(body[0]) // 2], "solo x solo"]
    got = {r.doc_id: r for r in licenses.scanned(docs(spark, texts), ["doc_id"], templates=licenses.TEMPLATES + whole, phrases={"solo": "one", "a b": "two"}).select("*", licenses.labels().alias("labels")).collect()}
    assert [got[i]["labels"] for i in range(7)] == [["abc-2.0"], ["abc-2.0"], ["abc-2.1"], ["bsd-2-clause"], ["bsd-3-clause"], ["abc-2.1"] if got[5].labels else [], ["one"]]
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (2, 0, 2)


def test_chains_against_every_chain():
    rnd = random.Random(9)
    for _ in range(60):
        templates = tuple((str(i), " ".join(rnd.choice("abcde") for _ in range(rnd.randrange(6, 14)))) for i in range(3))
        sc = licenses.Scanner(templates, {"zz z": "z"})
        number = {w.decode(): i for i, w in enumerate(sc.vocabulary)}
        text = [c for c in (rnd.choice("abcde") for _ in range(14)) if c in number]
        _, runs = sc.scan([number[c] for c in text], 0)
        best = {}
        for start, n, state in runs:
            for template, place in sc.automaton.ends_of(state):
                if template < 3:
                    best.setdefault(template, []).append((start, place - n, n))

        def longest(found, covered, end, last, size):
            top = covered
            for start, at, n in found:
                fresh = n - max(0, end - at)
                if at + n > end and start > last - max(0, end - at) and start > last - n and fresh > 0 and start - last <= 3 * size and (start, at, n) > last_of[0]:
                    kept, last_of[0] = last_of[0], (start, at, n)
                    top = max(top, longest(found, covered + fresh, at + n, start + n - 1, size))
                    last_of[0] = kept
            return top

        for template, found in best.items():
            last_of = [(-1, -1, -1)]
            tops = []
            for one in found:
                last_of[0] = one
                tops.append(longest(found, one[2], one[1] + one[2], one[0] + one[2] - 1, sc.sizes[template]))
            chained = sc.chained(runs)
            if template in chained:
                assert chained[template][0] == max(tops)


def test_matching_statistics():
    """The automaton's longest matches equal those found by trying every run."""
    rnd = random.Random(4)
    templates = tuple((str(i), " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(5, 14)))) for i in range(6))
    sc = licenses.Scanner(templates, {"a b": "ab", "c a d": "cad"})
    every = [t.split() for _, t in templates] + [["a", "b"], ["c", "a", "d"]]
    number = {w.decode(): i for i, w in enumerate(sc.vocabulary)}
    for _ in range(40):
        text = [rnd.choice("abcd") for _ in range(30)]
        places, runs = sc.scan([number[c] for c in text], 0)
        assert sorted(places) == sorted((i, k) for k, p in enumerate((["a", "b"], ["c", "a", "d"])) for i in range(30) if text[i : i + len(p)] == p)
        inside = lambda run: any(run == t[i : i + len(run)] for t in every for i in range(len(t)))
        longest = [max(n for n in range(e + 1) if n == 0 or inside(text[e - n : e])) for e in range(1, 31)]
        want = [(e - n + 1, n) for e, n in enumerate(longest) if n >= licenses.MIN_RUN and (e == 29 or longest[e + 1] <= n)]
        assert [(a, n) for a, n, _ in runs] == want


def test_sharding(spark, texts):
    many = texts * 3
    for part_rows in (sharding.PART_ROWS, 2):
        _sharding_holds(sharding.sharded(docs(spark, many), ["doc_id"], shards=5, slots=64, part_rows=part_rows).collect(), many)
    assert sharding.sharded(docs(spark, []), ["doc_id"]).count() == 0
    assert sharding.sharded(docs(spark, ["a", "b"], [None, None]), ["doc_id"]).count() == 2


def _sharding_holds(out, many):
    assert len(out) == len(many)
    by = {}
    for r in out:
        assert r.size == len((many[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((many[r.doc_id] or "").encode())
        by.setdefault(r.shard, []).append(r.slot)
        assert r.next_shard in (r.shard, 5)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    shard_of = {}
    assert all(shard_of.setdefault(r.virtual_slot, r.shard) == r.shard for r in out)


def test_maps_balance_and_move_little():
    rnd = random.Random(5)
    sizes = {s: (rnd.randrange(1, 1000), 1) for s in range(400)}
    first = sharding.first_map(sizes, 7, 400)
    load = [sum(sizes[s][0] for s in range(400) if first[s] == k) for k in range(7)]
    assert max(load) - min(load) < 1000
    second = sharding.grown_map(first, sizes, 7)
    assert all(b in (a, 7) for a, b in zip(first, second))
    total = sum(b for b, _ in sizes.values())
    assert abs(sum(sizes[s][0] for s in range(400) if second[s] == 7) - total / 8) < 1000


def test_stored_map_moves_only_what_it_must(spark, tmp_path):
    folder = str(tmp_path / "map")
    run = lambda texts, shards: {r.doc_id: (r.virtual_slot, r.shard) for r in sharding.sharded(docs(spark, texts), ["doc_id"], shards=shards, slots=512, folder=folder).collect()}
    versions = lambda: sharding.stored_map(spark, folder, 512)
    assert run([], 4) == {} and versions() == (0, None)
    texts = ["x" * (i % 50) for i in range(2000)]
    first = run(texts, 4)
    assert versions()[0] == 1 and run(texts, 4) == first and versions()[0] == 1
    same = run(texts + ["y"], 4)
    assert all(same[d] == x for d, x in first.items()) and versions()[0] == 1
    heavy = first[0][1]  # all new bytes go to one shard
    big = [t + "z" * 300 if first[i][1] == heavy else t for i, t in enumerate(texts)]
    moved = run(big, 4)
    assert versions()[0] == 2 and all(first[d][1] == heavy for d in first if moved[d] != first[d])
    load = [sum(len(big[d]) + 8 for d in moved if moved[d][1] == k) for k in range(4)]
    assert max(load) <= 1.1 * sum(load) / 4
    grown = run(big, 5)
    assert versions()[0] == 3 and {k for d, (_, k) in grown.items() if grown[d] != moved[d]} == {4}
    fewer = run(big, 4)
    assert versions()[0] == 4 and {k for _, k in fewer.values()} <= set(range(4))
    with pytest.raises(ValueError):
        sharding.stored_map(spark, folder, 32)


def pii_brute(t):
    out = []
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (k == "card" and not (16 <= len(d) <= 19 and luhn(d))) or (k == "phone" and not 8 <= len(d) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_pii(spark):
    rnd = random.Random(6)
    alphabet = "0123456789.@+-() ab_%É\n"
    texts = [None, "", "a@b.c_d@e.f", "x@y@z.co a.@b.c..d", "1.2.3.4.5.6.7.8 256.1.1.1 000.00255.1.1 1.2.3", "4111 1111-1111 1111 4111111111111111 41111111111111112222", "+1 (555) 123-4567 +12 +1-----------2 ++1234567890123456", "😀 é me@x.yz 😀 10.0.0.1", "9" * 5000, "a" * 5000, "a@" + "b." * 3000 + "c", "1 " * 4000, " é ".join(f"10.{i % 300}.3.{i % 256} a{i}@b.cd" for i in range(3000))]
    texts += ["".join(rnd.choice(alphabet) for _ in range(60)) for _ in range(300)]
    texts += ['token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" x', "call 555-123-4567 now"] * 5
    found = pii.spans(docs(spark, texts), ["doc_id"]).collect()
    assert len(found) == len(texts)
    for r in found:
        t = texts[r.doc_id]
        assert [(s.kind, s.start, s.end) for s in r.base] == pii_brute(t), t
        assert all(t[s.start : s.end] == s.match for s in [*r.base, *r.added])
        assert not any(a.start < b.end and b.start < a.end for a in r.added for b in r.base)
    assert pii.spans(docs(spark, []), ["doc_id"]).count() == 0
    df = docs(spark, ["to me@x.yz or 10.0.0.1"])
    red = pii.spans(df, ["doc_id", "text"]).select(pii.redacted(F.col("text"), F.concat("base", "added")).alias("t")).first().t
    assert red == "to <email> or <ip>"


def test_pii_adds_national_numbers_and_written_addresses(spark):
    real = ["call 555-123-4567 now", "Tel. (0301) 234567, or fax: 030 1234567", "ask ann.b (at) mail.example.org today", "write bob[at]host.de."]
    plain = ["order 555-123-4567 shipped", "in 1999 2000 2001 2002", "meet (at) noon", "we met (at) home", "account 12345678", "ids 0301 234567 seen", "call it off after 1234567 tries"]
    texts = [f"{t} {i}" for i in range(40) for t in real + plain * 3]
    found = pii.spans(docs(spark, texts), ["doc_id"]).collect()
    want = {real[0]: {"555-123-4567"}, real[1]: {"0301) 234567", "030 1234567"}, real[2]: {"ann.b (at) mail.example.org"}, real[3]: {"bob[at]host.de."}}
    for r in found:
        t = texts[r.doc_id].rpartition(" ")[0]
        got = {s.match for s in r.added}
        assert got == want.get(t, set()) or (t == real[1] and len(got) == 2), (texts[r.doc_id], got)


def test_pii_recall_on_other_texts(spark):
    """Fitted on some texts, measured on others: at least nine in ten of the planted cases that no base pattern has, and hardly anything else."""
    rnd = random.Random(12)

    def text(i):
        digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
        word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9)))
        phone, code = f"{digits(3)}{rnd.choice('-. ')}{digits(3)}{rnd.choice('-. ')}{digits(4)}", "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        planted, body = rnd.choice([(phone, f"{rnd.choice(['call', 'Phone:', 'tel.', 'fax'])} {phone}"), (m := f"{word()} (at) {word()}.org", m), (code, f"token = \"{code}\""), ("", f"order {phone}"), ("", f"in {digits(4)} {digits(4)}"), ("", f"we {word()} (at) {word()}"), ("", word() * 4)])
        return planted, f"{word()} {word()} {body} {word()}"

    train, test = [text(i) for i in range(1500)], [text(i) for i in range(400)]
    model = pii.learnt(docs(spark, [t for _, t in train]))
    got = {r.doc_id: [s.match.strip() for s in r.added] for r in pii.spans(docs(spark, [t for _, t in test]), ["doc_id"], model=model).collect()}
    hit = sum(bool(p) and any(p in m or m in p for m in got[i]) for i, (p, _) in enumerate(test))
    extra = sum(len(got[i]) for i, (p, _) in enumerate(test) if not p)
    assert hit >= 0.9 * sum(bool(p) for p, _ in test) and extra <= 0.05 * len(test)


def test_boosting_separates():
    import numpy as np

    from gridlark.llm.boosting import fitted, threshold

    x = np.array([[a, b] for a in range(4) for b in range(3)])
    p, n = np.where((x[:, 0] > 1) & (x[:, 1] == 2), 50.0, 1.0), np.where((x[:, 0] > 1) & (x[:, 1] == 2), 1.0, 50.0)
    forest = fitted(x, p, n)
    s = forest.scores(x)
    assert s[(x[:, 0] > 1) & (x[:, 1] == 2)].min() > s[~((x[:, 0] > 1) & (x[:, 1] == 2))].max()
    assert threshold(s, p, n, 0.9) > s[~((x[:, 0] > 1) & (x[:, 1] == 2))].max()
    assert threshold(s, p, n, 0.9999) == float("inf")


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|user|>", "\\l\\p\\\\", "a|b\\", "", None, "é😀<|", "\\\\l<"]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)], "extra") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", "odd|<role", None][: c % 8])]
    rows += [(None, 0, "user", "x", "e"), (3, None, "user", "n", "e"), *[(4, 0, "system", nasty[4], "e")] * 2]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.formatted(df).select("*", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert {r.conv_id for r in out} == set(want)
    for r in out:
        turns = [(a, b) for _, a, b in sorted(want[r.conv_id])]
        assert [(x.role, x.text) for x in r.turns] == turns
        assert r.loss == "".join(b for a, b in turns if a == "assistant")
        state, refused = "start", -1
        for i, (a, _) in enumerate(turns):
            if a not in chat.DEFAULT.follows.get(state, ()) and refused < 0:
                refused = i
            state = a
        assert r.refused_turn == refused and r.valid == (refused < 0 and state == "assistant")
    assert chat.formatted(df.filter("false")).count() == 0


def test_digests_match_python(spark):
    t = "é\n" * 3
    assert spark.range(1).select(F.sha2(F.lit(t).cast("binary"), 256)).first()[0] == hashlib.sha256(t.encode()).hexdigest()


def test_pii_learns_from_every_row(spark, monkeypatch):
    """Counts behind the trees and the threshold hold each row's candidate, however many rows there are."""
    seen = []
    fitted, threshold = pii.fitted, pii.threshold
    monkeypatch.setattr(pii, "fitted", lambda x, p, n: seen.append((p + n).sum()) or fitted(x, p, n))
    monkeypatch.setattr(pii, "threshold", lambda scores, p, n, least: seen.append((p + n).sum()) or threshold(scores, p, n, least))
    pii.learnt(spark.range(60_000).selectExpr("concat('tel. 555 010 ', 1000 + id % 9000, ' of ', id % 7) as text"))
    assert sum(seen) == 60_000 and len(seen) == 2
