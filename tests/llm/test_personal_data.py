import hashlib
import re

import pytest

from basalt.llm.personal_data import KINDS, as_text, personal_data


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


TEXTS = [
    None, "", "plain words", "a@b.c", "x a.b+c@d-e.f.g, y@z", "a@b.c@d.e", "a@b.c_d@e.f", "@x.y a@.b a@b.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.2.3.4 1.2.3", "12.34.56.789 99999999999999999999.1.1.1",
    "4539 1488 0343 6467 and 4539148803436467 4539-1488-0343-6467 4539148803436468", "45391488034364671 4 5 3 9 1 4 8 8 0 3 4 3 6 4 6 7", "1" * 25 + " " + "0" * 14, "+1 (555) 123-4567 +49 30 1234567. +1 2 +12345678901234567 +5551234567890x +1 (2) ",
    "é😀 a@b.co 😀+1 (555) 123-4567", "12--4539148803436467", "5 4539148803436467", "1 " * 30_000, "a" * 60_000 + "@", "9" * 60_000, "+1" + " " * 20_000, "a@b" + ".c" * 20_000, "a@b.c " * 2_000, "1.2.3.4,5.6.7.8;a@1.2.3.4",
]


def table(spark, texts):
    return spark.createDataFrame([(n, t, 1, "x") for n, t in enumerate(texts)], "doc_id long, text string, row int, kind string")


def test_base_spans(spark):
    rows = personal_data(table(spark, TEXTS)).select("id", as_text(__import__("pyspark").sql.functions.col("base")).alias("b")).collect()
    got = {r["id"]: r["b"] for r in rows}
    for n, t in enumerate(TEXTS):
        assert got[n] == base(t or ""), (n, (t or "")[:50], hashlib.sha256(got[n].encode()).hexdigest())


def test_contexts_find_what_the_patterns_miss(spark):
    known = [f"Please write to Phone: +1 (555) 123-{n:04d} for more" for n in range(20)]
    new = ["Please call our Phone: 555-12a4-99 now", "Its Phone: 555-12b4-98."]
    other = [f"the number {n} is not a phone" for n in range(20)] + ["the a@b.co address"] * 5
    rows = {r["id"]: r for r in personal_data(table(spark, known + new + other)).collect()}
    for n, text in enumerate(new, len(known)):
        value = re.search(r"555[^ ]*[0-9]", text)
        assert [tuple(s) for s in rows[n]["spans"]] == [(value.start(), 3, value.end())] and rows[n]["base"] == []
    assert all(rows[n]["spans"] == rows[n]["base"] for n in range(len(known))) and all(not rows[n]["spans"] for n in range(22, 42))


def brute_bootstrap(texts, rounds=3, least=5, sure=0.8, accept=0.9):
    """Spans that the patterns add to texts of words with single blanks between: (text, start, kind, end)."""
    wrapping, edges = "\"'`()[]{}<>.,;:!?#*&%$", []
    plain = lambda w: re.sub("[0-9]", "0", w).lower()
    for n, text in enumerate(texts):
        spans = [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in base(text).split(",") if s)]
        words, at = text.split(" "), 0
        marks = [bool(re.search("[0-9@]", w)) for w in words]
        for i, w in enumerate(words):
            inner = w.lstrip(wrapping)
            start, value = at + len(w) - len(inner), inner.rstrip(wrapping).lower()
            at += len(w) + 1
            if not marks[i] or not value:
                continue
            end = start + len(value)
            over = [(k if a >= start else -2, text[a:b].lower()) for a, k, b in spans if a < end and start < b]
            kind, value = max(over, default=(None, value))
            if kind == -2:
                continue
            before = text[: start - (len(w) - len(w.lstrip(wrapping)))]
            if kind is None and re.search(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)[\"']?\s*[:=]\s*$", before) and len(value) >= 12:
                kind = 4
            cues = []
            if i and not marks[i - 1]:
                cues.append(plain(words[i - 1]))
                if i > 1 and not marks[i - 2]:
                    cues.append(plain(words[i - 2]) + " " + plain(words[i - 1]))
            if i + 1 < len(words) and not marks[i + 1]:
                cues.append(" " + plain(words[i + 1]))
            edges += [(cue, value, kind, (n, start, end)) for cue in cues]
    by = {}
    for cue, value, kind, _ in edges:
        by.setdefault(cue, {}).setdefault(value, []).append(kind)
    stands = {}
    for text in texts:
        words = [plain(w) for w in text.split(" ")]
        for i, w in enumerate(words):
            for cue in (w, f"{words[i - 1]} {w}" if i else None, f" {w}" if i else None):
                stands[cue] = stands.get(cue, 0) + 1
    top = lambda kinds: max((k for k in kinds if k is not None), default=None)
    likely = {}
    for cue, values in by.items():
        kinds = [top(k) for k in values.values()]
        most = max(kinds.count(k) for k in range(5))
        if most >= least and most >= 0.3 * len(kinds):
            likely[cue] = max(0, stands[cue] - sum(map(len, values.values())))
    seeds = {(v, k): 1.0 for cue in likely for v, kinds in by[cue].items() if (k := top(kinds)) is not None}
    known, patterns = dict(seeds), {}
    for _ in range(rounds):
        patterns = {}
        for cue, others in likely.items():
            for kind in range(5):
                scores = [known[v, kind] for v in by[cue] if (v, kind) in known]
                confidence = sum(scores) / (len(by[cue]) + others)
                if len(scores) >= least and confidence >= sure:
                    patterns[cue, kind] = min(confidence, 0.99)
        doubts = {}
        for (cue, kind), confidence in patterns.items():
            for v, kinds in by[cue].items():
                if top(kinds) is None:
                    doubts[v, kind] = doubts.get((v, kind), 1.0) * (1 - confidence)
        best = {}
        for (v, kind), doubt in sorted(doubts.items(), key=lambda x: (x[1], x[0][1])):
            if 1 - doubt >= accept:
                best.setdefault(v, (kind, 1 - doubt))
        known = seeds | {(v, kind): score for v, (kind, score) in best.items()}
    found = {(v, k) for (v, k), score in known.items() if score < 1 or k == 4}
    return sorted({(n, a, k, b) for cue, v, kind, (n, a, b) in edges if kind in (None, 4) for k in range(5) if (cue, k) in patterns and (v, k) in found})


def test_scores_against_brute_force(spark):
    import random

    rng, texts = random.Random(8), []
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    fill = ["the", "of", "a", "one", "with", "for"]
    for n in range(150):
        words = rng.choices(fill, k=4)
        words += rng.choice(6 * [["call", f"+1(555)123-{n:04d}", "now"]] + [
            ["call", f"555-{n}x", "now"], ["mail", f"u{n}@x.org", "soon"], ["mail", f"u{n}(at)x.org", "soon"], ["mail", "it", "soon"],
            ["token", "=", f'"{hexes(40)}"###'], ["bearer", "="], ["token", "=", "1"], ["host", f"10.0.0.{n}", "up"], ["host", f"node{n % 7}", "up"], ["commit", hexes(40)], [f"x{n}", f"y{n}"],
        ])
        texts.append(" ".join(words + rng.choices(fill, k=3)))
    want = brute_bootstrap(texts)
    assert {k for _, _, k, _ in want} >= {3, 4}
    got = [(r["id"], s["start"], s["kind"], s["end"]) for r in personal_data(table(spark, texts)).collect() for s in r["spans"] if s not in r["base"]]
    assert sorted(got) == want


def test_secrets_need_a_pattern(spark):
    texts = [f'So token = "{n:040x}"### it is' for n in range(1, 7)] + [f"commit {n:040x} and" for n in range(9)]
    rows = {r["id"]: r for r in personal_data(table(spark, texts)).collect()}
    assert all([tuple(s) for s in rows[n]["spans"]] == [(12, 4, 52)] and rows[n]["base"] == [] for n in range(6)) and not any(rows[n]["spans"] for n in range(6, 15))
    assert not any(r["spans"] for r in personal_data(table(spark, texts[:2])).collect())


def test_long_texts_of_identifiers_take_linear_work(spark):
    text = "a@b.co " * 20_000 + "1" * 100_000 + " 1.2.3.4" * 20_000
    assert len(personal_data(table(spark, [text])).first()["spans"]) == 40_000


def test_repeated_rows_and_no_rows(spark):
    twice = table(spark, ["a@b.co"]).unionByName(table(spark, ["a@b.co", None]))
    assert sorted(len(r["spans"]) for r in personal_data(twice).collect()) == [0, 1, 1]
    assert personal_data(twice.where("false")).count() == 0


@pytest.mark.parametrize("digits", ["4539148803436467", "4539148803436468", "00000000000000"])
def test_luhn(spark, digits):
    from pyspark.sql import functions as F

    from basalt.llm.personal_data import luhn as column

    assert spark.range(1).select(column(F.lit(digits))).first()[0] == luhn(digits)
