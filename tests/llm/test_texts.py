"""Mixing, languages, personal data, contamination, quality and repeats against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strataforge.llm import contamination, lang_id, mixing, pii, quality, repeats

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# personal data
def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    parts = [*"a1@.%+- -0059(){}\n", "😀", "é", "4111 1111-1111 1111", "+1 (017) 555-7713", "1.2.3.4", "x@a.b", "2555.1.1.1", "9" * 20]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))) for k in range(400)] + [(900, None), (901, ""), (902, "1" * 20000), (903, "a." * 10000), (904, "a@b.c@d.e%f@g.h " * 200)]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(texts, DOC)).collect()}
    for k, t in texts:
        want = base_spans(t or "")
        assert got[k]["base_sha256"] == sha(",".join(f"{n}:{a}:{b}" for n, a, b in want)), t
        assert [got[k][f"n_{n}"] for n in ("email", "ip", "card", "phone")] == [sum(w[0] == n for w in want) for n in ("email", "ip", "card", "phone")]


def test_added_spans_and_redaction(spark):
    texts = [(1, "iban GB82 WEST 1234 5698 7654 32 and DE00 1234"), (2, "ssn 123-45-6789"), (3, "no 123-45-6789"), (4, "mail x@y.zz and 1.2.3.4, 😀 +1 (017) 555-7713!"), (5, None)]
    table = spark.createDataFrame([(*t, "x") for t in texts], DOC + ", base_spans string")
    assert dict(rows(pii.digest(table), "doc_id", "spans"))[1] == "iban:5:32"
    assert [dict(rows(pii.digest(table), "doc_id", "spans"))[k] for k in (2, 3)] == ["national_id:4:15", ""]
    clean = dict(rows(pii.redact(spark.createDataFrame(texts, DOC)), "doc_id", "text"))
    assert clean[4] == "mail [EMAIL] and [IP], 😀 [PHONE]!" and clean[5] is None and clean[3] == texts[2][1]


# contamination
def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute_hits(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, held = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    held |= windows[tuple(w[k : k + n])]
        held = sorted(str(x) for x in held if x is not None)
        out.append((i, len(w), len(hit), len(held), sha(",".join(held)), bool(hit)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "b", "É", "é", "c9", "Zz", "x-y"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 5, 10, 12, 15]))) for k in range(30)] + [(None, text(12)), (3, "x"), (100, None)]
    docs = [(k if k % 9 else None, text(rng.choice([0, 1, 2, 5, 30, 80])) + " " + (rng.choice(items)[1] or "")) for k in range(60)]
    docs += docs[:3] + [(5, "other"), (500, None)]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    assert rows(contamination.contamination(d, b), *columns) == brute_hits(docs, items)
    assert rows(contamination.contamination(d, b.limit(0)), *columns) == brute_hits(docs, [])
    assert contamination.contamination(d.limit(0), b).count() == 0


# repeats
def brute_repeats(docs):
    split = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(5)
    bases = [" ".join(rng.choice("abcdefghij") for _ in range(200)) for _ in range(5)]
    docs = []
    for k in range(60):
        base, own = rng.choice(bases).split(" "), []
        for _ in range(rng.randint(1, 5)):
            at = rng.randint(0, 150)
            own += base[at : at + rng.randint(20, 60)] + [str(rng.random())] * rng.randint(0, 2)
        docs.append((k if k % 7 else None, rng.choice([" ", "\n", "  "]).join(own)))
    docs += [(200 + p, " ".join(str(k % p) for k in range(60)) + " z" * (p % 3)) for p in range(2, 40)]
    docs += [(1, docs[1][1]), (2, "other text"), (100, None), (101, ""), (102, "a " * 100), (None, docs[0][1])]
    got = repeats.remove_repeats(spark.createDataFrame(docs, DOC))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(docs)
    assert repeats.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


# quality
def base_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(runs)
    inside = {j for k, r in enumerate(runs) if often[r] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark):
    rng = random.Random(8)
    docs = [(k, "".join(rng.choice(["the ", "of ", "a\n", "b ", "# ", "é", "\t", "x y z "]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "de", None])) for k in range(150)]
    docs += [(900, None, "en"), (901, "", None), (902, "a b c " * 3000, "en"), (902, "a b c " * 3000, "en")]
    got = quality.quality(spark.createDataFrame(docs, DOC + ", lang string")).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs)
    for k, t, _ in docs:
        r, want = by_id[k], base_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality.quality(spark.createDataFrame([], DOC + ", lang string")).count() == 0


def test_distance(spark):
    d = lambda p, q: spark.range(1).select(quality.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()["d"]
    assert abs(d([1.0, 0.0], [0.0, 1.0]) - 1) < 1e-12 and d([0.5, 0.5], [0.5, 0.5]) == 0


# languages
def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = lang_id.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, None, "s"), (None, "12 34!", "en", "s"), (2, "", "en", None)], DOC + ", lang string, source string")
    assert rows(lang_id.held_out_languages(odd), "lang_pred", "score") == [("und", 0.0)] * 3
    assert lang_id.held_out_languages(docs.limit(0)).count() == 0


# mixing
def fill(sizes):
    names = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(names)}
    left, out, rest = sum(sizes.values()), {}, set(names)
    while rest:
        total = sum(weight[k] for k in rest)
        over = [k for k in rest if left * weight[k] / total > 3 * sizes[k]]
        if not over:
            return out | {k: left * weight[k] / total for k in rest}
        for k in over:
            out[k] = 3 * sizes[k]
            rest.discard(k)
        left -= sum(out[k] for k in over)
    return out


def test_mixing(spark):
    docs = [(k, "w " * (k % 50), ["a", "b", None, "ä", "z", "big"][k % 6 if k % 3 else 5]) for k in range(400)] + [(1000, None, "q"), (1001, "only", "r"), (1001, "only", "r")]
    table = spark.createDataFrame(docs, DOC + ", source string")
    got, sizes, source, taken = mixing.mix(table).collect(), Counter(), {}, Counter()
    for i, t, s in docs:
        sizes[s] += len((t or "").split())
        source[i] = s
    want = fill(sizes)
    assert len(got) == len(docs)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]) for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table).collect()), key=str)
    assert mixing.mix(table.limit(0)).count() == 0
