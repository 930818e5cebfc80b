"""The training-data operators on small and awkward tables, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers as P
import pytest

from tessera.llm import candidates, common, op1_line_dedup, op2_license_scan, op3_substring_dedup, op4_quality_rules, op5_token_counts, op6_decontamination, op7_toxicity, op8_byte_bpe, op9_near_dedup, op10_pii
from tessera.llm.boosting import Boosted
from tessera.llm.components import components
from tessera.llm.suffix_sort import classes_at, deep_shallow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, u long, line string, kept boolean"


def table(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "en" if (i or 0) % 2 else None, None, len(t or ""), "k", 1, "l", False) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def awkward() -> list[tuple]:
    """Null and empty texts, a long one, ties, repeated rows, a null id."""
    rng = random.Random(4)
    words = ["the", "alpha", "beta", "gamma", "Delta", "é", "12", "x.y"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(["  ", " ", "\n"]) for _ in range(n))
    base = text(120)
    rows = [(i, text(rng.randrange(60))) for i in range(30)] + [(100 + i, base) for i in range(4)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, text(6000)), (204, "x" * 3000), (205, base + " tail"), (206, base[:-1] + "?"), (None, base), (7, rows[7][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward()).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(30)] + [(3, 0, 1), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "the alpha beta"), (2, awkward()[31][1][:300]), (3, None), (4, ""), (None, "gamma"), (2, "é 12 x.y"), (5, "absent words here")]
    return spark.createDataFrame(rows, "item_id long, text string")


def results(df) -> dict:
    out: dict = {}
    for r in df.collect():
        d = r.asDict()
        out.setdefault(d.pop("doc_id"), []).append(d)
    return out


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[200 + i] == 100 for i in range(50)) and got[301] == 300
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_take_no_step_that_changes_nothing(spark, monkeypatch):
    written, plain = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: written.append(label) or plain(df, label))
    for edges, steps in (([(1, 2), (1, 3), (5, 4), (4, 6)], 0), ([(1, 2), (2, 3)], 1), ([(1, 3), (2, 3)], 1)):
        written.clear()
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {n: 4 if n > 3 else 1 for e in edges for n in e} and len(written) == 1 + steps


def test_line_dedup_counts_sets_only_of_pairs_that_may_be_alike(spark, monkeypatch):
    made, plain = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: made.append(plain(df, label)) or made[-1])
    lines = ["a line of some length, of which the end differs", "a line of some length, of which the end differed", "a line of some length, but little else is like it", "ab " * 40, "ab " * 90]
    tried = spark.createDataFrame([(0, 1), (0, 2), (3, 4)], "u long, v long")
    links = op1_line_dedup.verified(tried, spark.createDataFrame(list(enumerate(lines)), "id long, line string"), 80)
    assert {tuple(r) for r in links.collect()} == {(0, 1), (3, 4)}
    assert {(r["u"], r["v"]): r["sum"] is None for r in made[0].collect()} == {(0, 1): False, (0, 2): True, (3, 4): False}


def test_line_dedup(spark, docs):
    out = op1_line_dedup.line_dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    seen, want = set(), {}
    for i, t in sorted({(i, t or "") for i, t in awkward() if i is not None}):
        kept = []
        for line in t.split("\n"):
            if len(line.encode()) < op1_line_dedup.SHORT and line.strip(" "):
                if line in seen:
                    continue
                seen.add(line)
            kept.append(line)
        want[i] = kept
    got = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    short = lambda lines: [x for x in lines if len(x.encode()) < op1_line_dedup.SHORT]
    assert all(short((got[i] or "").split("\n")) == short(want[i]) for i in want)


def test_line_dedup_joins_near_lines(spark):
    line = "a line of text that is long enough to be compared by its shingles, all of them, and changed in one place only"
    near = line.replace("changed", "chanted")
    got = {r["doc_id"]: r["text"] for r in op1_line_dedup.line_dedup(table(spark, [(1, line), (2, near + "\nother words"), (3, "quite another line, which has nothing in common with the first one at all")])).collect()}
    assert got == {1: line, 2: "other words", 3: "quite another line, which has nothing in common with the first one at all"}


def line_components(lines: list[str], size: int = 8) -> set[frozenset]:
    """Groups of lines linked at 0.8, by all pairs."""
    sets = [{x[i : i + size] for i in range(len(x) - size + 1)} for x in (line.encode() for line in lines)]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups: dict = {}
    for i in range(len(lines)):
        groups.setdefault(find(i), set()).add(lines[i])
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize(("small", "whole"), [(64, 4096), (4, 4096), (4, 4)])
def test_line_dedup_pairs_all_of_a_hot_bucket(spark, monkeypatch, small, whole):
    monkeypatch.setattr(op1_line_dedup, "SMALL", small)
    monkeypatch.setattr(op1_line_dedup, "WHOLE", whole)
    # one bucket of twelve lines in id order: twins never stand side by side, nor with the least
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common_part = word(110)
    lines = []
    for _ in range(6):
        own = word(50)
        lines += [common_part + own, common_part + own[:-1] + "#"]
    ids = {i: x for i, x in enumerate(lines[0::2] + lines[1::2])}
    frame = spark.createDataFrame([(i, x) for i, x in ids.items()], "id long, line string")
    held = candidates.members(spark.createDataFrame([(i, 1) for i in ids], "id long, key long"))
    tried = candidates.pairs(held)
    links = op1_line_dedup.verified(tried, frame, 80)
    signed = op1_line_dedup.signatures(frame.repartition(2, "id"))
    fresh = op1_line_dedup.open_pairs(held, components(links), signed, frame, 80)
    more = op1_line_dedup.verified(fresh.join(tried, ["u", "v"], "left_anti"), frame, 80)
    got = {frozenset((ids[r["u"]], ids[r["v"]])) for r in links.union(more).collect()}
    assert got == line_components(lines) and len(got) == 6


def test_line_dedup_finds_twins_in_a_hot_template(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common_part = word(120)
    lines = []
    for _ in range(250):
        own = word(30)
        lines += [common_part + own, common_part + own[:-8] + word(8)]
    out = op1_line_dedup.line_dedup(table(spark, list(enumerate(lines)), 2))
    kept = sum(r["text"] != "" for r in out.collect())
    assert kept == len(line_components(lines))


def test_line_dedup_bands_find_pairs_at_the_threshold(spark):
    # 40 shingles a line, 32 of them in its twin: similarity 0.8
    rng = random.Random(13)
    rows = []
    for i in range(1200):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(47))
        rows += [(2 * i, line), (2 * i + 1, line[:39])]
    bands = op1_line_dedup.band_rows(spark.createDataFrame(rows, "id long, line string").repartition(2, "id"))
    keys: dict = {}
    for r in bands.collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    assert sum(not keys[2 * i] & keys[2 * i + 1] for i in range(1200)) == 0


def test_line_dedup_signs_alike_in_blocks_of_any_size(spark, monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab cdefgé") for _ in range(n)) for n in [*range(8, 45), 200]]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string").repartition(2, "id")
    signed = lambda: sorted(tuple(r) for r in op1_line_dedup.signatures(frame).collect())
    blocks = signed()
    monkeypatch.setattr(op1_line_dedup, "BLOCK", 2)
    assert blocks == signed() and len(blocks) == len(lines)


def test_line_dedup_hashes_each_shingle_once_and_no_band(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        signed = op1_line_dedup.signatures(spark.createDataFrame([(0, "a line of some length")], "id long, line string").repartition(2, "id"))
        plan = signed._jdf.queryExecution()
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package")
        said = debug.codegenString(plan.executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.optimizedPlan().toString().count("xxhash64(") == op1_line_dedup.BLOCK
    # the JVM leaves methods of over 8000 bytes to its interpreter
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said)]
    assert sizes and max(sizes) <= 8000


def test_line_dedup_band_keys_differ(spark):
    # all minima of a line of one shingle are turns of one hash
    frame = spark.createDataFrame([(i, chr(97 + i) * 9) for i in range(26)], "id long, line string").repartition(2, "id")
    keys = [r["key"] for r in op1_line_dedup.band_rows(frame).collect()]
    assert len(set(keys)) == len(keys) == 26 * op1_line_dedup.BANDS


def test_members_sort_by_one_number(spark):
    bands = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9), (5, 9), (6, 9)], "id long, key long")
    held = candidates.members(bands)
    assert sorted(tuple(r) for r in held.select("key", "id", "members").collect()) == [(7, 1, 2), (7, 2, 2), (9, 4, 3), (9, 5, 3), (9, 6, 3)]
    sorts = re.findall(r"Sort \[(.*?)\]", held._jdf.queryExecution().toString())
    assert sorts and all("id#" not in by for by in sorts)  # Spark sorts by radix only if there is one


def test_line_dedup_verifies_long_lines_in_linear_time(spark):
    rng = random.Random(4)
    line = "".join(rng.choices("abcdefgh ", k=400_000))
    frame = spark.createDataFrame([(0, line), (1, line[:-9] + "#"), (2, line[: len(line) * 3 // 4])], "id long, line string")
    tried = spark.createDataFrame([(0, 1), (0, 2)], "u long, v long")
    began = time.time()
    links = [tuple(r) for r in op1_line_dedup.verified(tried, frame, 80).collect()]
    assert links == [(0, 1)] and time.time() - began < 20  # 400,000 copies of a line take longer


def test_line_dedup_reads_on_only_lines_that_share_a_bucket(spark, monkeypatch):
    seen, plain = [], op1_line_dedup.verified
    monkeypatch.setattr(op1_line_dedup, "verified", lambda pairs, lines, percent: seen.append({r["line"] for r in lines.collect()}) or plain(pairs, lines, percent))
    rng = random.Random(5)
    own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(90)) for _ in range(40)]
    near = [own[3][:-1] + "#", own[7][:-1] + "#"]
    kept = op1_line_dedup.keepers(table(spark, list(enumerate([*own, *near, own[9], "short"]))))
    assert kept.count() == 5  # two pairs of near lines, and one line that stands twice
    assert len(seen) == 3 and all(x == {own[3], own[7], *near} for x in seen)


def test_line_dedup_verifies_sets_not_lengths(spark):
    lines = ["=" * 40, "=" * 100, "ha " * 12, "ha " * 40, "sixteen bytes, 1", "sixteen bytes, ", "a longer line that is alike in nothing"]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string").repartition(2, "id")
    held = candidates.members(op1_line_dedup.band_rows(frame))
    pairs = candidates.pairs(held)
    links = {frozenset((lines[r["u"]], lines[r["v"]])) for r in op1_line_dedup.verified(pairs, frame, 80).collect()}
    assert links == {g for g in line_components(lines) if len(g) > 1} and len(links) == 3


def test_prefix_pairs_copy_no_rows_of_the_largest_component(spark, monkeypatch):
    rows = [(i, 0, [*range(20), 1000 + i]) for i in range(50)] + [(99, 99, [*range(20), 5000])]
    made, plain = {}, common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: made.setdefault(label, plain(df, label)))
    got = candidates.prefix_pairs(spark.createDataFrame(rows, "id long, component long, s array<long>"), 80)
    assert {(r["u"], r["v"]) for r in got.collect()} == {(i, 99) for i in range(50)}
    assert max(d.count() for label, d in made.items() if label != "prefix") <= 5


def test_neighbours_of_different_components(spark):
    words = op1_line_dedup.WORDS
    rows = [(0, i, 6 if i == 6 else 1, 6, *[0] * len(words)) for i in range(1, 7)] + [(0, 7, 7, 6, *[0x7F7F7F7F7F7F7F] * len(words))]
    opened = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("key", "id", "component", "members", *words)))
    assert {tuple(r) for r in op1_line_dedup.neighbours(opened).collect()} == {(3, 6), (4, 6), (5, 6)}


def test_prefix_pairs_lose_no_link(spark):
    """Sets around a template: every pair of different components at the threshold is among the candidates."""
    rng = random.Random(31)
    template, sets = list(range(60)), {}
    for i in range(160):
        own = [1000 + rng.randrange(400) for _ in range(rng.randrange(3, 40))]
        sets[i] = set(template[: rng.randrange(30, 60)] + own)
        if i % 3 == 0 and i:
            sets[i] = set(sorted(sets[i - 1])[rng.randrange(12) :]) | {5000 + i}
    comps = {i: i if i % 7 else 0 for i in sets}
    rows = [(i, comps[i], list(x)) for i, x in sets.items()] + [(1000, 1000, [])]
    got = {(r["u"], r["v"]) for r in candidates.prefix_pairs(spark.createDataFrame(rows, "id long, component long, s array<long>"), 80).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and comps[a] != comps[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want <= got and len(want) > 20 and len(got) < 160 * 159 // 4


def test_bucket_pairs_connect_every_bucket(spark):
    """Whatever their sizes, the pairs of a bucket join all its members."""
    sizes = {1: 1, 2: 2, 3: 3, 4: 70, 5: 700}
    bands = spark.createDataFrame([(k, 100_000 * k + i) for k, n in sizes.items() for i in range(n)], "key long, id long")
    pairs = candidates.pairs(candidates.members(bands))
    comps = {r["node"]: r["component"] for r in components(pairs).collect()}
    assert all(len({comps.get(100_000 * k + i, 100_000 * k + i) for i in range(n)}) == 1 for k, n in sizes.items())
    assert pairs.count() <= 2 * sum(sizes.values())


def test_near_dedup_rows_that_share_an_id(spark):
    """Texts of one doc_id are all compared, in whatever order they come."""
    rng = random.Random(32)
    words = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    one, two = words(100), words(100)
    rows = [(1, " ".join(one)), (2, " ".join([*one, "x"])), (3, " ".join(two)), (2, " ".join([*two, "y"]))]
    for order in (rows, rows[::-1]):
        got = {r["doc_id"]: r["component_id"] for r in op9_near_dedup.near_components(table(spark, order)).collect()}
        assert got == {1: 1, 2: 1, 3: 1}


def test_toxicity_restores_long_runs_and_tokens(spark):
    plain = "you are an idiot and he is not " * 50
    restorer = op7_toxicity.Restorer(op7_toxicity.CharacterModel(op7_toxicity.trigram_counts(table(spark, [(1, plain)]))))
    assert restorer.word("idi" + "o" * 60 + "t") == "idiot"
    run = " ".join("heisnotyouareandheisnotandyouareanidiot")
    assert len(run) > 64 and "idiot" in restorer.spelled(run)
    assert restorer.spelled("i d i o t") == ["idiot"]
    assert len(restorer.spelled(" ".join("you" * 4000))[0]) > 6000


def test_pii_thresholds_count_all_documents(spark):
    rng = random.Random(21)
    words = ["the", "alpha", "beta", "gamma", "delta", "river"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(600)] + [(None, "x"), (2000, None), (2001, "")]
    frame = table(spark, rows)
    model = op10_pii.fit(frame, sample_docs=200)
    held = [(i, t) for i, t in rows if i is not None and op10_pii.is_held(i)]
    want = sum(len(op10_pii.planted_candidates(i, t or "", op10_pii.HELD_PLANTS)) for i, t in held)
    assert op10_pii.score_histogram(common.doc_texts(frame), model.trees)[:, 3].sum() == want and len(held) > 150
    assert set(model.thresholds) == set(op10_pii.MORE)


#: Contexts and forms that planting doesn't have.
PRIVATE = ['pwd -> "{hex}"', "export SECRET_KEY={mixed}", "my login token is {hex}", "phone number 555 010 4477 at night", "ring her mobile 0171 5550199", "ann_lee [at] tinytown [dot] org", "bob(at)lake.net", "your passport 40551234567 please"]
HARMLESS = ["git checkout of commit {hex} went on", "md5sum is {hex}", "the number 8837465529301844 of them", "ISBN 978-1-23-456789-0", "we meet (at) noon.tomorrow", "serial 5550104477123", "table_of_results_for_night_12", "plain 20240131123456 stamp"]


def test_pii_finds_what_it_has_not_seen(spark):
    """Recall and precision on hand-made private and harmless spans in the texts of the corpus."""
    rng = random.Random(22)
    words = ["the", "alpha", "beta", "gamma", "delta", "river"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    model = op10_pii.fit(table(spark, [(i, text(40)) for i in range(1500)]), sample_docs=1200)
    found = {}
    for name, forms in (("private", PRIVATE), ("harmless", HARMLESS)):
        for form in forms:
            hits = 0
            for _ in range(40):
                made = form.replace("{hex}", "".join(rng.choice("0123456789abcdef") for _ in range(40))).replace("{mixed}", "".join(rng.choice("abcdefGHIJKL0123456789") for _ in range(30)) + "1")
                whole = f"{text(6)} {made} {text(6)}"
                hits += bool(model.added(whole, op10_pii.base_spans(whole)))
            found[name, form] = hits / 40
    recall = sum(v for (n, _), v in found.items() if n == "private") / len(PRIVATE)
    false = sum(v for (n, _), v in found.items() if n == "harmless") / len(HARMLESS)
    assert recall >= 0.75 and false <= 0.15, found


def test_pii_on_planted_spans_of_held_out_documents(spark):
    rng = random.Random(23)
    words = ["the", "alpha", "beta", "gamma", "delta", "river"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(900)]
    model = op10_pii.fit(table(spark, rows), sample_docs=600)
    caught = missed = wrong = 0
    for i, t in rows:
        if op10_pii.is_held(i):
            for label, x in op10_pii.planted_candidates(i, t, 3):
                kind = op10_pii.MORE[int(x[0])]
                hit = model.trees.probability(np.array([x]))[0] >= model.thresholds.get(kind, 2)
                caught, missed, wrong = caught + (hit and label), missed + (label and not hit), wrong + (hit and not label)
    assert caught / (caught + missed) >= 0.85 and caught / (caught + wrong) >= 0.85


@pytest.mark.parametrize("text", ["0" * 4400 + ".2.3.4", "1" * 9000 + ".1.1.1", "a" * 9000 + "[at]b.c", "9" * 20_000, "x" * 70 + "(at)example.org"])
def test_pii_of_long_runs(text):
    base = op10_pii.base_spans(text)
    assert [b for b in base if b[0] == "ip"] == ([("ip", 0, 4406)] if text.startswith("0") else [])
    contact = [c for c in op10_pii.candidates(text) if c[0] == "contact"]
    assert contact == ([("contact", 0, len(text))] if "at" in text else [])


def test_license_scan(spark, docs):
    text = "MIT License and mit  license\nReleased under the MIT license.\nGNU General Public License\nThis work is licensed under the GNU General Public License, version 3."
    got = results(op2_license_scan.license_scan(table(spark, [(1, text), (2, "permit license"), (3, None), (4, "apache\nLICENSE")])))
    assert got[1][0] | {"score": 1.0} == {"n_words": 26, "n_base": 5, "first_word": 0, "last_word": 21, "base_labels": "gpl,mit", "labels": "gpl,gpl-notice,mit,mit-notice", "score": 1.0}
    assert got[2][0]["n_base"] == 0 and got[2][0]["first_word"] is None and got[2][0]["labels"] == "" and got[3][0]["n_words"] == 0
    assert got[4][0]["base_labels"] == "apache"
    wrapped = "# Redistribution and use in source and binary forms,\n# with or without modification, are permitted\n# provided that the following\n# conditions are met:"
    got = results(op2_license_scan.license_scan(table(spark, [(1, wrapped), (2, wrapped.replace("\n", "\n\n\n\n\n"))])))
    assert got[1][0]["labels"] == "bsd-text" and got[2][0]["labels"] == ""
    assert op2_license_scan.license_scan(docs).count() == docs.count()


def brute_spans(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(b)))
        out[i] = {"n_bytes": len(b), "n_removed": sum(gone), "n_spans": runs, "kept_sha256": hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()}
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup(spark, docs, monkeypatch, hot):
    if hot:  # the ways for overlarge groups and hot anchors
        monkeypatch.setattr(op3_substring_dedup, "GROUP", 2)
        monkeypatch.setattr(op3_substring_dedup, "SENT", 1)
    want = brute_spans(list(dict.fromkeys(awkward())))
    got = results(op3_substring_dedup.substring_dedup(docs))
    assert {i: r[0] for i, r in got.items()} == want and len(got[7]) == 2 and got[7][0] == got[7][1]


def test_substring_dedup_of_rows_without_id(spark):
    """Hundreds of texts without an id, and texts that share one, are told apart."""
    rng = random.Random(41)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(150, 260)))
    texts = [text() for _ in range(1000)]
    for i in range(0, 1000, 4):
        texts[i] = texts[i][:20] + texts[(i * 7 + 3) % 1000][:130] + texts[i][20:]
    got = {r["kept_sha256"]: r for r in op3_substring_dedup.substring_dedup(table(spark, [(None, t) for t in texts])).collect()}
    order = sorted(dict.fromkeys(texts), key=lambda t: op3_substring_dedup.number_of(None, t.encode()))
    want = brute_spans(list(enumerate(order)))
    assert {w["kept_sha256"]: (w["n_removed"], w["n_spans"]) for w in want.values()} == {k: (r["n_removed"], r["n_spans"]) for k, r in got.items()}
    assert sum(w["n_removed"] > 0 for w in want.values()) > 100


def test_deep_shallow_order():
    rng = np.random.default_rng(1)
    strings = rng.integers(97, 99, (400, 40)).astype(np.uint8)
    strings[::3, :30] = 97
    group = rng.integers(0, 4, 400)
    order, shared = deep_shallow(strings, group)
    rows = [(int(group[i]), strings[i].tobytes()) for i in order]
    assert rows == sorted(rows)
    for depth in (0, 7, 25, 40):
        c = classes_at(order, shared, depth)
        keys = {}
        assert all(keys.setdefault(c[i], (group[i], strings[i, :depth].tobytes())) == (group[i], strings[i, :depth].tobytes()) for i in range(400))
        assert len(keys) == len({(group[i], strings[i, :depth].tobytes()) for i in range(400)})


def test_quality_rules(spark, docs, labels):
    def brute(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)}
        lines, seen, dup = (t or "").split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(twice)

    got = results(op4_quality_rules.quality_rules(docs, labels))
    for i, t in awkward():
        if i == 203:
            continue
        n = brute(t)
        assert all(tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n for r in got[i]) or i is None
        assert all(r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r["base_failed"] and r["kept"]) for r in got[i])


def test_binomial_in_closed_form():
    from math import comb

    for n, p in ((10, 0.3), (200, 0.02), (400, 0.9)):
        for k in range(0, n, max(1, n // 9)):
            plain = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(op4_quality_rules.binomial_cdf(k, n, p) - plain) < 1e-9
    assert op4_quality_rules.binomial_cdf(4_900_000, 1_000_000_000, 0.005) < 1e-9
    assert not op4_quality_rules.certified(0, 1849, 0.02 / 6, 0.05 / 24) and op4_quality_rules.certified(0, 1850, 0.02 / 6, 0.05 / 24)


def test_quality_cutoffs_reject_where_labels_certify(spark):
    """Good texts without symbols certify cutoffs; a text full of them is rejected then, and no good one is."""
    rng = random.Random(42)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(2 * i + 1, " ".join(word() for _ in range(14)), "en") for i in range(2500)] + [(10_000, " ".join(word() + "#$%&*" for _ in range(14)), "en"), (10_002, " ".join(word() for _ in range(14)), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows[:2500]], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in op4_quality_rules.quality_rules(docs, labels).collect()}
    assert not kept[10_000] and kept[10_002] and sum(not kept[i] for i, _, _ in rows[:2500]) <= 50


def test_certified_bounds():
    assert op4_quality_rules.certified(0, 3000, 0.001, 0.05) is (0.999**3000 <= 0.05)
    assert not op4_quality_rules.certified(0, 100, 0.001, 0.05)
    good = {r: {"en": {10_000: 100_000}} for r in op4_quality_rules.RULES}
    good["symbols"]["en"] = {50: 99_000, 99: 1000}
    cut = op4_quality_rules.select_cutoffs(good, 0.005, 0.95)
    assert cut["symbols"]["en"] == op4_quality_rules.RULES["symbols"][1][49]


ODD = ["", " ", "  a  b ", "\n\n a\t b  ", "x" * 3000, "ab" * 500 + " " * 99, "日本語テキスト" * 20, "\x1c a\x1f b\x85 　 c", "▁▁a ▁", "<s> </s> <0x0A>", "I'll can't 'S 123,456", "\x00\x01", "😀 é é"]


def test_token_counts():
    import sentencepiece

    rng = random.Random(2)
    count = op5_token_counts.transducer(P.path("piece_bpe_32k.model")).count
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ODD + ["".join(rng.choice(" \nabcé日1.,▁😀") for _ in range(rng.randrange(80))) for _ in range(300)] + [" ".join(rng.choice(["abé", "", "tion", "of"]) for _ in range(40_000))]
    assert [count(t) for t in texts] == [len(sp.encode(t)) for t in texts]


@pytest.mark.parametrize("chunk", [3, 7, 40])
def test_token_counts_of_chunks_cut_inside_words(monkeypatch, chunk):
    """State maps of chunks compose to the count of the whole, wherever the cuts fall, in any order of composition."""
    import sentencepiece

    monkeypatch.setattr(op5_token_counts, "CHUNK", chunk)
    rng = random.Random(43)
    t = op5_token_counts.transducer(P.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ODD[:9] + ["".join(rng.choice(" \nabcé日1.,▁😀") for _ in range(rng.randrange(200))) for _ in range(60)] + [" ".join(rng.choice(["internationalisation", "", "tion", "of"]) for _ in range(60)) for _ in range(30)]
    for text in texts:
        assert t.count(text) == len(sp.encode(text))
        whole = " " + text.replace("▁", " ")
        maps = [t.chunk_map(whole[i : i + chunk]) for i in range(0, len(whole), chunk)]
        left = maps[0]
        for m in maps[1:]:
            left = t.compose(left, m)
        if text:
            assert t.close(left[0]) + (left[1] or 0) + t.close(left[2]) == len(sp.encode(text))


def test_byte_bpe_queue_against_plain_merges():
    """Ranks in any order, so that merges make pairs of lower ranks too."""
    rng = random.Random(44)
    for _ in range(300):
        tokens = {bytes([c]) for c in b"abc"}
        while len(tokens) < 14:
            a, b = rng.choice(sorted(tokens)), rng.choice(sorted(tokens))
            tokens.add(a + b)
        order = sorted(tokens - {b"a", b"b", b"c"})
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate([b"a", b"b", b"c", *order])}
        bpe = op8_byte_bpe.ByteBPE(ranks, r"[\s\S]+")
        for _ in range(10):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60)))
            parts = [piece[i : i + 1] for i in range(len(piece))]
            if piece not in ranks:
                while True:
                    found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
                    if not found:
                        break
                    i = min(found)[1]
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
            else:
                parts = [piece]
            assert bpe.merge(piece) == [ranks[p] for p in parts]


def test_byte_bpe(spark, docs):
    import tiktoken

    rng = random.Random(3)
    bpe = op8_byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    spaced = ["".join(rng.choice(["a", "b1", "'s", "\n", "\xa0", " ", " ", "é", ".", "\u2009"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in ODD + spaced + [" ".join(x.split()) for x in spaced] + ["".join(rng.choice(" \nabcé日1.,'▁😀") for _ in range(rng.randrange(80))) for _ in range(300)]:
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(t) and bpe.decode(ids) == t.encode()
    got = results(op8_byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    assert all(r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in awkward() for r in got[i][:1] if i != 7)


def brute_hits(t, items):
    words = op6_decontamination.words_of((t or "").encode())
    hit, own = set(), set()
    for k, text in items:
        w = op6_decontamination.words_of((text or "").encode())
        for i in range(max(1, len(w) - 12) if w else 0):
            win = w[i : i + 13]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    own.add(k)
    return len(words), len(hit), len(own)


def test_fm_index_against_plain_search():
    rng = np.random.default_rng(45)
    for n, symbols in ((1, 2), (63, 3), (64, 3), (700, 2), (5000, 30)):
        text = rng.integers(0, symbols + 1, n)
        index = op6_decontamination.FMIndex(text, symbols)
        for size in (1, 2, 5):
            if n < size:
                continue
            patterns = np.stack([text[i : i + size] for i in rng.integers(0, n - size + 1, 20)] + [rng.integers(1, symbols + 1, size) for _ in range(20)])
            patterns = patterns[(patterns > 0).all(axis=1)]
            which, low, high = index.search(patterns)
            got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
            want = {k: [i for i in range(n - size + 1) if (text[i : i + size] == p).all()] for k, p in enumerate(patterns)}
            assert got == {k: v for k, v in want.items() if v}
    assert len(index.position) <= len(text) // op6_decontamination.SAMPLE + 2


def test_benchmark_blocks_keep_their_bound(spark):
    items = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(30)], "item_id long, text string")
    blocks = list(op6_decontamination.item_blocks(items, 500))
    assert [last for _, last in blocks] == [False] * (len(blocks) - 1) + [True] and sum(len(b) for b, _ in blocks) == 30
    assert all(sum(len(t) for _, t in b) <= 500 for b, _ in blocks)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, docs, benchmark, block):
    items = [(str(r["item_id"]), r["text"]) for r in benchmark.collect() if r["item_id"] is not None]
    got = results(op6_decontamination.contamination(docs, benchmark, block_bytes=block))
    for i, t in awkward():
        if i == 203 or i is None:
            continue
        want = brute_hits(t, items)
        assert all((r["n_words"], r["n_hit"], r["n_items"]) == want and r["contaminated"] == (want[1] > 0 and 20 * want[1] >= want[0]) for r in got[i])


def test_toxicity_restores_and_scores(spark):
    rng = random.Random(9)
    words = [a + b for a in ("ston", "ther", "and", "ing", "ble") for b in ("er", "ion", "at", "es", "")]
    rows, labels = [], []
    for i in range(300):
        body = [rng.choice(words) for _ in range(40)]
        if i % 3 == 0:
            body[rng.randrange(40)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs, given = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op7_toxicity.fit(docs, given)
    model.score("")
    assert model.restorer.word("1d10t") == "idiot" and model.restorer.spelled("an m.o.r.o.n or") == ["moron"]
    assert model.score("ston ther 1d10t ble") > 0.5 > model.score("ston ther and ble")
    out = results(op7_toxicity.toxicity(docs, given))
    assert sum(out[i][0]["predicted"] == int(i % 3 == 0) for i in range(300)) >= 297
    assert op7_toxicity.accepted(docs, given).columns == docs.columns


def test_toxicity_decoder_against_all_paths(spark):
    """Viterbi finds the best of all readings of short tokens."""
    model = op7_toxicity.CharacterModel(op7_toxicity.trigram_counts(table(spark, [(1, "you idiot that is a silly little test of letters and idiots " * 20)])))

    def readings(token, at=0, last="", letters="", cost=0.0):
        if at == len(token):
            yield letters, cost
            return
        sign = token[at]
        options = [(sign, 0.0)] * (sign in op7_toxicity.SYMBOL) + [(c, op7_toxicity.SUBSTITUTE) for c in op7_toxicity.LOOKALIKE.get(sign, "")]
        skip = op7_toxicity.SEPARATE if sign in op7_toxicity.SEPARATORS else op7_toxicity.COLLAPSE if sign == last and sign in op7_toxicity.SYMBOL else None
        if not options and skip is None:
            skip = op7_toxicity.SUBSTITUTE
        for c, price in options:
            yield from readings(token, at + 1, sign, letters + c, cost + price)
        if skip is not None:
            yield from readings(token, at + 1, sign, letters, cost + skip)

    def scored(letters, cost):
        symbols = [0, 0, *(op7_toxicity.SYMBOL[c] for c in letters), 0]
        return cost + sum(model.log[a][b][c] for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))

    rng = random.Random(46)
    for token in ["1d1ot", "i.d.i", "sillly", "t3$t", "l!ttle"] + ["".join(rng.choice("idtse13$!.-l") for _ in range(rng.randrange(1, 8))) for _ in range(300)]:
        best = max(scored(*r) for r in readings(token))
        got = model.decode(token)
        assert abs(max(scored(x, c) for x, c in readings(token) if x == got) - best) < 1e-9


def test_toxicity_of_awkward_tables(spark, docs, labels):
    out = op7_toxicity.toxicity(docs, labels)
    assert out.count() == docs.count() and all(0 <= r["score"] <= 1 for r in out.collect())
    assert op7_toxicity.toxicity(docs, labels.where("false")).where("predicted = 1").count() == 0


def brute_components(rows, size):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(spark, docs, size):
    got = results(op9_near_dedup.near_components(docs, size=size))
    want = brute_components(awkward(), size)
    assert {i: (r[0]["n_shingles"], r[0]["component_id"]) for i, r in got.items() if i is not None} == want
    assert got[None][0]["kept"]


def test_near_dedup_chains(spark):
    """Near copies whose links form a chain lie in one component, whatever their heads."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows, now = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(now)))
        now[rng.randrange(120)] = f"v{i}"
        now[rng.randrange(120)] = f"u{i}"
    got = results(op9_near_dedup.near_components(table(spark, rows), size=2))
    assert {i: r[0]["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in brute_components(rows, 2).items()}
    kept = op9_near_dedup.kept_documents(table(spark, rows), size=2)
    assert kept.count() == len({c for _, c in brute_components(rows, 2).values()}) and kept.columns == table(spark, rows).columns


BASE_TEXTS = ["a@b.c x@y.co.uk @z.w u@v", "1.2.3.4 256.1.1.1 001.2.3.4.5.6.7.8", "4111 1111 1111 1111 and 4111111111111112 4111-1111-1111-1111-9", "+1 (743) 555-3824 +12 +1234567890123456", "a@b.c@d.e", "é é@x.y a.@-.b", "1" * 5000 + " " + "a" * 5000, "+1 " + " " * 500]


def test_pii_base():
    def brute(t):
        out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m.group().split("."))) <= 255]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"[\x20-]", "", m.group())
            if 16 <= len(d) <= 19 and op10_pii.luhn(d):
                out.append(("card", m.start(), m.end()))
        return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]

    rng = random.Random(8)
    for t in BASE_TEXTS + ["".join(rng.choice("a1.@+- (") for _ in range(rng.randrange(60))) for _ in range(2000)]:
        assert op10_pii.base_spans(t) == brute(t)
    assert op10_pii.luhn("4111111111111111") and not op10_pii.luhn("4111111111111112")


def test_pii_model(spark, docs):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f"some words {rng.randrange(10**9)} here" if i % 2 else f'the token = "{secret}" and user{i}@mail.example.com'))
    got = results(op10_pii.find_pii(table(spark, rows)))
    assert sum("secret:" in got[i][0]["spans"] for i in range(0, 200, 2)) >= 95
    assert all(got[i][0]["n_email"] == 1 and "[email]" in got[i][0]["redacted"] for i in range(0, 200, 2))
    assert op10_pii.find_pii(docs).count() == docs.count()


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = Boosted().fit(x[:1500], y[:1500]).calibrate(x[1500:], y[1500:])
    p = model.probability(x)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95 and p.min() >= 0 and p.max() <= 1


def test_empty_tables(spark, labels, benchmark):
    none, empty = table(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert op1_line_dedup.line_dedup(none).count() == 0
    assert op2_license_scan.license_scan(none).count() == 0
    assert op3_substring_dedup.substring_dedup(none).count() == 0
    assert op4_quality_rules.quality_rules(none, labels).count() == 0
    assert op5_token_counts.token_counts(none, P.path("piece_bpe_32k.model")).count() == 0
    assert op6_decontamination.contamination(none, benchmark).count() == 0
    assert op6_decontamination.contamination(table(spark, [(1, "a b")]), empty).collect()[0]["contaminated"] is False
    assert op7_toxicity.toxicity(none, labels).count() == 0
    assert op8_byte_bpe.encode_documents(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert op9_near_dedup.near_components(none).count() == 0
    assert op10_pii.find_pii(none).count() == 0


def test_token_counts_of_rows(spark, docs):
    got = results(op5_token_counts.token_counts(docs, P.path("piece_bpe_32k.model"), limit=20))
    assert got[200][0] == {"n_bytes": 0, "n_tokens": 0, "over_limit": False} and len(got[7]) == 2
    assert all(r["over_limit"] == (r["n_tokens"] > 20) for rs in got.values() for r in rs)


def test_scratch_is_the_sessions(spark):
    assert common.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
