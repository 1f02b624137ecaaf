"""The pipeline against a plain version of its five stages."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import bpe, near_dedup, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = quality_rules.stage(docs).cache()
    verdicts = quality_rules.op10(docs)
    assert a.columns == docs.columns and a.count() == verdicts.filter("kept").count() < docs.count()
    b = near_dedup.stage(a).cache()
    assert b.columns == docs.columns and b.count() == near_dedup.classes(a).filter("kept").count()
    c = substring_dedup.stage(b).cache()
    gone = substring_dedup.op8(b).filter("n_removed > 0")
    assert c.columns == docs.columns and c.count() == b.count() - gone.filter("n_removed = n_words").count()
    assert c.filter("n_chars <> char_length(text)").count() == 0


def line_fails(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    words = bare.count(" ") + 1
    return (
        any(p in bare.lower() for p in quality_rules.BOILERPLATE)
        or 10 * sum(c in "#*$%&|<>" for c in bare) > len(bare)
        or bare.count("|") >= 3
        or (sum(c in ">›»→" for c in bare) >= 2 and words <= 12)
        or len(re.findall("!!", bare)) >= 3
        or (not re.search("[a-zà-öø-ÿ]", bare) and sum("A" <= c <= "Z" for c in bare) >= 20)
        or bare.endswith(("...", "…"))
        or (bool(re.search(r"https?://|www\\.", bare)) and words <= 3)
        or 2 * sum("0" <= c <= "9" for c in bare) > len(bare)
        or (words <= 3 and bare[-1] not in ".!?;:…\"'”’»)]。！？")
    )


def quality(rows):
    out = {}
    for k, t in rows.items():
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        left = [x for x in dict.fromkeys(lines) if not line_fails(x)]
        size = sum(map(len, lines))
        if len(w) >= 50 and 2 * len(hit) <= len(w) and 100 * (size - sum(map(len, left))) <= 30 * size:
            out[k] = "\n".join(left)
    return out


def near(rows):
    sets = {}
    for k, t in rows.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in rows}
    find = lambda k: k if root[k] == k else find(root[k])
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: t for k, t in rows.items() if find(k) == k}


def passages(rows):
    seen, out = set(), {}
    for k in sorted(rows):
        w, gone = WORD.findall(rows[k]), set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone.update(range(i, i + 20))
            seen.add(g)
        if not gone:
            out[k] = rows[k]
        elif len(gone) < len(w):
            out[k] = " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def personal(rows):
    """The fixture's personal data, as planted: nothing else in it looks like any."""
    marks = {"jo.doe@mail.example.com": "[EMAIL]", "10.20.30.40": "[IP]", "4041894974608795": "[CARD]", "+1 (988) 555-2485": "[PHONE]",
             "password=b7db7aa4a5fcc78305": "[CREDENTIAL]", "SSN 219-09-9999": "SSN [NATIONAL_ID]"}
    out = {}
    for k, t in rows.items():
        for old, new in marks.items():
            t = t.replace(old, new)
        out[k] = t
    return out


def corpus():
    rng = random.Random(12)
    syllables = ["ta", "ro", "min", "ke", "lu", "sor", "ven", "da"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    prose = lambda n: "\n".join(line(rng.randint(8, 20)) for _ in range(n))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "too short.", prose(9), prose(9) + "\nHome | News | About | Login\nAll rights reserved.", prose(3) + "\nBUY!! NOW!! CHEAP!! " + "x " * 400]
    base = prose(12)
    texts += [base, base, base.replace("ta", "TA", 3)]
    for k in range(4):
        w = base.split(" ")
        w[5 + k] = word()
        texts.append(" ".join(w))
    texts += [f"{line(30)} {passage} {line(30)}" for _ in range(4)]
    texts += [prose(6) + f"\n{line(9)[:-1]} {x} {line(9)}" for x in (
        "jo.doe@mail.example.com", "10.20.30.40", "4041894974608795", "+1 (988) 555-2485", "password=b7db7aa4a5fcc78305", "SSN 219-09-9999")]
    texts += [prose(400), line(70), "\n".join(["short menu"] * 30 + [prose(3)])]
    return texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = [(10 * i, t, "en", "s", len(t) if t else 0) for i, t in enumerate(corpus())]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_every_stage_equals_its_plain_version(spark, folder):
    rows = {10 * i: t or "" for i, t in enumerate(corpus())}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [len(rows)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (quality, near, passages, personal), strict=False):
        rows, docs = plain(rows), stage(spark, docs, folder).cache()
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == rows, name
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] and "[CREDENTIAL]" in "".join(rows.values())


def test_run_equals_the_plain_version(spark, folder):
    rows = {10 * i: t or "" for i, t in enumerate(corpus())}
    for plain in (quality, near, passages, personal):
        rows = plain(rows)
    library = bpe.ForcedBoundaryBPE(bpe.default_vocabulary()).library
    want = set()
    for k, t in rows.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.add((k, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(w[3] for w in want) // 2048)
