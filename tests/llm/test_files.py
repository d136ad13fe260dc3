"""Packing, GIF, WARC, licences, quality rules and the pipeline."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docframe.llm import gif, licences, packing, quality_rules, queries, warc
from docframe.llm.arrowmap import shared_dir
from tests.conftest import same

# -- packing --


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 400), max_size=25))
@settings(max_examples=60, deadline=None)
def test_plan_packs_everything_once(counts):
    histogram = np.zeros(61, np.int64)
    for k, v in counts.items():
        histogram[k] = v
    plan = packing.make_plan(histogram)
    length = np.repeat(np.arange(61), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram]) if histogram.sum() else np.zeros(0, np.int64)
    sequence, offset = plan.place(length, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    used = np.bincount(sequence, length, plan.sequences) if len(length) else np.zeros(0)
    assert (used <= 60).all() and (used > 0).all()
    first = np.concatenate([[True], sequence[1:] != sequence[:-1]]) if len(length) else np.zeros(0, bool)
    assert (offset[first] == 0).all() and (offset[1:][~first[1:]] == (offset + length)[:-1][~first[1:]]).all()  # gapless
    assert plan.sequences <= 1.2 * first_fit(length, 60) + 2


def first_fit(lengths, capacity):
    """Sequences that first fit, longest first, takes."""
    free: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        k = next((k for k, room in enumerate(free) if room >= n), None)
        if k is None:
            free.append(capacity - n)
        else:
            free[k] -= n
    return len(free)


def test_plans_take_no_more_sequences_than_first_fit_on_the_whole():
    rng = np.random.default_rng(5)
    own = other = 0
    for _ in range(300):
        histogram = np.zeros(61, np.int64)
        histogram[rng.integers(1, 61, rng.integers(1, 8))] = rng.integers(1, 100)
        own += packing.make_plan(histogram).sequences
        other += first_fit(np.repeat(np.arange(61), histogram), 60)
    assert own <= 1.01 * other


def test_patterns_fill_sequences_and_fit():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 129, 20_000), minlength=129)
    rows = packing.patterns(histogram)
    assert (rows.sum(1) == 128).all() and len(np.unique(rows, axis=0)) == len(rows)
    x = packing.nnls(rows, histogram)
    assert (x >= 0).all()
    left = histogram - np.bincount(rows.ravel(), np.repeat(x, 3), 129)
    tokens = np.arange(129)
    assert np.abs(left * tokens).sum() < 0.2 * (histogram * tokens).sum()
    plan = packing.make_plan(histogram)
    assert plan.sequences <= np.ceil((histogram * tokens).sum() / 128) * 1.006


@pytest.mark.parametrize("n, mean", [(1000, 6.0), (30_000, 5.5), (300_000, 6.0)])
def test_patterns_place_most_documents(n, mean):
    """Lengths like those of real texts: rounded counts of the fit place over 90 % of them, what is filled afterwards not counted,
    and the number of sequences is the least possible."""
    lengths = np.clip(np.random.default_rng(n).lognormal(mean, 1.2, n).astype(int), 1, 4096)
    histogram = np.bincount(lengths, minlength=4097)
    plan = packing.make_plan(histogram)
    assert plan.fitted > 0.9 * n and plan.fitted + plan.filled <= n and plan.sequences == -(-lengths.sum() // 4096)
    assert len(plan.at) <= 100_000


def test_uniform_lengths_need_their_pairs():
    histogram = np.bincount(np.random.default_rng(1).integers(1, 513, 200_000), minlength=513)
    plan = packing.make_plan(histogram)
    assert plan.fitted > 0.9 * histogram.sum()
    assert plan.sequences <= 1.01 * (histogram * np.arange(513)).sum() / 512


def test_fit_is_near_the_least_squares():
    """Against many steps of plain projected gradient over all patterns; far fewer patterns have a count."""
    weight = (np.arange(129) / 128) ** 2
    for seed in range(5):
        rng = np.random.default_rng(seed)
        histogram = np.bincount(np.clip(rng.lognormal(3.5, 0.8, 3000).astype(int), 1, 128), minlength=129)
        rows = packing.patterns(histogram)
        matrix = np.zeros((129, len(rows)))
        np.add.at(matrix, (rows.T, np.arange(len(rows))[None].repeat(3, 0)), 1)
        matrix[0] = 0
        square = matrix.T @ (weight[:, None] * matrix)
        step, want = 1 / np.linalg.norm(square, 2), np.zeros(len(rows))
        for _ in range(3000):
            want = np.maximum(0, want - step * (square @ want - matrix.T @ (weight * histogram)))
        x = packing.nnls(rows, histogram)
        cost = [(weight * (matrix @ v - histogram) ** 2).sum() for v in (x, want, 0 * want)]
        assert (x >= 0).all() and cost[0] - cost[1] < 0.02 * cost[2]
        assert (x > 0).sum() <= 4 * (histogram > 0).sum()


def test_fit_of_few_lengths():
    for lengths in ([], [4096], [4095], [1], [2048, 2048], [4096] * 3 + [1], [100] * 100):
        histogram = np.bincount(np.array(lengths, int), minlength=4097)
        histogram[100] *= 10**9  # many of a length that is in no pattern
        plan = packing.make_plan(histogram)
        assert plan.sequences == {0: 0}.get(len(lengths), plan.sequences)
        tokens = int((histogram * np.arange(4097)).sum())
        assert plan.sequences >= -(-tokens // 4096) and (len(lengths) > 0) == (plan.sequences > 0)


def test_pack_operator(spark):
    texts = ["the cat sat", "", None, "word " * 9000, "the cat sat", "l'eau 日本"]
    df = spark.createDataFrame([(i % 5, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length long").repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    out = [r.asDict() for r in packing.pack(df, path).collect()]
    library = Tokenizer.from_file(path)
    want = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((i % 5, k, start, len(part), zlib.crc32(b"".join(struct.pack("<I", x) for x in part))))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    used = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096 and len(used) == -(-sum(r["length"] for r in out) // 4096)
    assert packing.pack(df.limit(0), path).count() == 0


# -- GIF --


@given(st.binary(max_size=3000), st.sampled_from([2, 4, 8]))
@settings(max_examples=60, deadline=None)
def test_lzw_round_trip(data, size):
    data = bytes(b & (1 << size) - 1 for b in data)
    assert gif.lzw_unpack(gif.lzw_pack(data, size), size, len(data)) == data


def test_lzw_fills_and_clears_its_table():
    for data in (np.random.default_rng(3).bytes(60_000), b"ab" * 40_000, bytes(70_000)):
        assert gif.lzw_unpack(gif.lzw_pack(data), 8, len(data)) == data


def test_lzw_with_a_full_table_kept():
    """A stream of literals that goes on with 12-bit codes after its table is full."""
    data = np.random.default_rng(4).bytes(6000)
    value, bits, entries = 256, 9, 258
    for k, b in enumerate(data):
        width = min(12, max(9, entries.bit_length()))
        value |= b << bits
        bits += width
        entries += k > 0 and entries < 4096
    assert gif.lzw_unpack(value.to_bytes(-(-bits // 8) + 2, "little"), 8, 6000) == data


def deferred(data, size, every=None):
    """A code stream by the rules of GIF 89a that clears its table only before every so many samples, not when it is full."""
    clear, first = 1 << size, (1 << size) + 2
    codes, bits = [], []
    table, n, prefix = {}, first, b""

    def put(code):
        codes.append(code)
        bits.append(min(12, max(size + 1, (n - 1).bit_length())))

    put(clear)
    for i in range(len(data)):
        b = data[i : i + 1]
        if every and i and i % every == 0:
            put(table.get(prefix, prefix[0]))
            if n < 4096:
                n += 1
            put(clear)
            table, n, prefix = {}, first, b""
        if not prefix or prefix + b in table:
            prefix += b
            continue
        put(table.get(prefix, prefix[0]))
        if n < 4096:
            table[prefix + b] = n
            n += 1
        prefix = b
    put(table.get(prefix, prefix[0]))
    if n < 4096:
        n += 1
    put(clear + 1)
    places = np.arange(12)
    return np.packbits(((np.array(codes)[:, None] >> places) & 1)[places < np.array(bits)[:, None]].astype(np.uint8), bitorder="little").tobytes(), len(codes)


@pytest.mark.parametrize("size", [2, 4, 8])
@pytest.mark.parametrize("every", [None, 100_000, 131])
def test_lzw_with_a_clear_code_deferred_for_long(size, every):
    data = bytes(b & (1 << size) - 1 for b in np.random.default_rng(6).bytes(300_000))
    stream, n = deferred(data, size, every)
    assert n > 3 << 13 and gif.lzw_unpack(stream, size, len(data)) == data
    w = 300
    made = screen(w, 1000, b"," + struct.pack("<HHHHB", 0, 0, w, 1000, 0x80 | 7) + bytes(range(256)) * 3 + bytes([size]) + gif._blocks(stream))
    assert next(iter(gif.decode(made))).canvas.shape == (1000, w, 4)


def image(left, top, w, h, samples, local=None, interlaced=False, size=2):
    flags = (0x80 | 1 if local else 0) | (0x40 if interlaced else 0)
    return b"," + struct.pack("<HHHHB", left, top, w, h, flags) + (local or b"") + bytes([size]) + gif._blocks(gif.lzw_pack(bytes(samples), size))


def control(delay, disposal, transparent=None):
    return b"!\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"


COLOURS = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def screen(w, h, *parts):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 1, 0, 0) + COLOURS + b"".join(parts) + b";"


def shown(frame):
    names = {(0, 0, 0, 255): "k", (255, 0, 0, 255): "r", (0, 255, 0, 255): "g", (0, 0, 255, 255): "b", (0, 0, 0, 0): ".", (9, 9, 9, 255): "x"}
    return ["".join(names[tuple(int(v) for v in p)] for p in row) for row in frame.canvas]


def test_disposal_transparency_palettes_and_interlace():
    data = screen(
        2, 2,
        control(5, 1), image(0, 0, 2, 2, [1, 1, 1, 1]),
        control(7, 3, 0), image(0, 0, 2, 1, [0, 2]),  # transparent; then back to before
        control(0, 2), image(1, 1, 1, 1, [3]),  # then cleared
        control(1, 0), image(0, 1, 1, 1, [1], local=bytes([0, 0, 0, 9, 9, 9, 0, 0, 0, 0, 0, 0])),
    )
    frames = list(gif.decode(data))
    assert [f.delay_ms for f in frames] == [50, 70, 0, 10]
    assert [shown(f) for f in frames] == [["rr", "rr"], ["rg", "rr"], ["rr", "rb"], ["rr", "x."]]
    rows = [[i % 4] * 3 for i in range(11)]
    order = [*range(0, 11, 8), *range(4, 11, 8), *range(2, 11, 4), *range(1, 11, 2)]
    laced = screen(3, 11, image(0, 0, 3, 11, [v for y in order for v in rows[y]], interlaced=True))
    assert shown(next(gif.decode(laced))) == [c * 3 for c in "krgbkrgbkrg"]
    assert shown(next(gif.decode(screen(2, 1, image(1, 0, 3, 2, [1] * 6))))) == [".r"]  # cut off at the screen's edge
    with pytest.raises(ValueError):
        list(gif.decode(b"not a gif at all"))


def test_gif_operators(spark, monkeypatch):
    monkeypatch.setattr(gif, "FRAME_ROWS", 4)
    payload = bytes(range(256)) * 5
    frames = list(gif.decode(gif.encode(payload)))
    assert len(frames) == 5 and b"".join(np.ascontiguousarray(f.drawn[:, :, 0]).tobytes() for f in frames) == payload
    df = spark.createDataFrame([(1, "text é", "m"), (2, None, "m"), (3, "", "m"), (4, "x" * 300_000, "m"), (1, "text é", "n")], "id long, text string, media string")
    out = {(r.id, r.n_bytes): r for r in gif.store_texts(df, keep_media=True).collect()}
    for (i, n), r in out.items():
        text = {1: "text é", 4: "x" * 300_000}.get(i, "").encode()
        padded = text + b"\0" * (64 if not n else -n % 64)
        assert n == len(text) and r.payload_bytes == len(padded) and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes == len(r.media) and sum(r.histogram) == len(padded)
    stored = gif.store_texts(df, keep_media=True).where("id = 1").limit(1)
    frame = gif.frames(stored, "media", "id").first()
    assert (frame.frame, frame.delay_ms, frame.width, frame.height) == (0, 100, 64, 1) and sum(frame.histogram) == 64
    assert gif.store_texts(df.limit(0)).count() == 0


# -- WARC --


def test_archive_round_trip():
    pages = [warc.record(i, f"http://x/{i}\r\nX: y", f"<p>{i} words and words {i * 7}</p>".encode() * 20, None if i % 3 else 0) for i in range(300)]
    data = warc.archive(pages)
    assert struct.unpack_from("<I", data)[0] == warc.MAGIC and len(data) < sum(map(len, pages)) / 4
    found = list(warc.records_of(data))
    assert len(found) == 300 and found[1][0]["x-page-id"] == "1" and found[1][1].endswith(b"</p>")
    assert found[1][0]["warc-target-uri"] == "http://x/1%0D%0AX:%20y"
    assert found[3][0]["warc-type"] == "revisit" and found[3][0]["x-refers-to-page-id"] == "0"
    for few in ([warc.record(None, None, b"", None)], [warc.record(7, "http://x", b"", None)], pages[:1], pages[:3]):
        data = warc.archive(few)
        assert struct.unpack_from("<I", data)[0] == warc.MAGIC and len(list(warc.records_of(data))) == len(few)


def test_warc_with_other_ids_and_long_payloads(spark):
    """Ids that are text, and a page of several megabytes."""
    folder = shared_dir(spark)
    long = "<p>" + "".join(f"{i * i} " for i in range(600_000)) + "</p>"
    df = spark.createDataFrame([("a/1", None, long), ("b/2", "http://b", "x"), ("c/3", None, "x")], "page_id string, url string, html string")
    out = {r.page_id: r for r in warc.read(warc.write(df, folder), folder, "string").collect()}
    assert out["a/1"].payload_bytes == len(long) and bytes(out["a/1"].html).decode() == long
    assert out["c/3"].record_type == "revisit" and out["c/3"].refers_to == "b/2"


@pytest.mark.parametrize("least, side", [(0, 32 << 20), (10, 32 << 20), (0, 0), (10, 0)])
def test_warc_operator(spark, monkeypatch, least, side):
    """Revisits found by a broadcast table, and, as if there were too many for that, by merging."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "SIDE_BYTES", side)
    monkeypatch.setattr(warc, "READERS", 1)
    rows = [(7, "u", "same long text"), (3, "u", "same long text"), (9, None, "same long text"), (4, "v", "tiny"), (5, "v", "tiny"), (6, "w", None), (8, "w", ""), (None, "x", "tiny"), (3, "u", "same long text"), (9, "u", "tiny"), (9, None, "same long text"), (4, "y", "an id of two payloads")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    folder = shared_dir(spark)
    out = warc.read(warc.write(df, folder, least), folder).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        h = h or ""
        head = first.get(h)
        again = i is not None and head is not None and head != i
        want.append((str(i), len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", str(head if again else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in out) == sorted(want)
    assert warc.read(warc.write(df.limit(0), shared_dir(spark)), folder).count() == 0


# -- native operators, against SQL on small tables --

TEXTS = [None, "", " \n\t", "Released under the MIT License.", "a b c d e f g h i", "x y z " * 30, "Home | About | News | More\n" * 2 + "A good sentence that is long enough to be kept, as it has words. Another one stands behind it, with other words in it, and ends here.",
         "Licensed under CC BY-NC 4.0.\n\nbody text follows here", "same line here\nsame line here\n### $$$", "p q r s t u v w p q r s t u v w p", "Ümläut über alles, auch hier. " * 12, "w " * 3000]


def documents(spark):
    rows = [(i * 16, t, "s" if i % 2 else "dir/sub") for i, t in enumerate(TEXTS)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_quality_rules(spark, duck):
    rows, df = documents(spark)
    out = quality_rules.judge(df.withColumn("kept", F.lit("clash"))).drop("text", "source")
    assert same(out, duck(quality_rules.ORACLE, documents=("doc_id BIGINT, text VARCHAR, source VARCHAR", rows)))
    cleaned = quality_rules.judge(df, clean_col="clean").where("doc_id = 96").first()
    assert "Home" not in cleaned.clean and cleaned.kept
    assert quality_rules.judge(df.limit(0)).count() == 0


FRENCH = "Il répondit : « je ne sais pas », puis il partit. Elle dit alors « bon », et ferma la porte sans un mot de plus ; le voisin, lui, cria « attendez » de loin."
GERMAN = "Der Dialog im Katalog war kurz. »Bitte anmelden«, sagte sie, »oder später wiederkommen«, und lachte, während er den Text über das Design in aller Ruhe las."
ENGLISH = "The catalog in the hall lists each design in full, and a long dialog in the second act explains why the heroes read more than one privacy policy before they leave the town for good."


def test_clean_texts_are_kept(spark, duck):
    """Quotes in guillemets, words that hold a site phrase, and texts of one line lose nothing; menus and footers do."""
    menu = "Home » Products » Lamps » Desk lamps\nAll rights reserved.\nHome | News | Sport | Weather | Contact\nPlease read more | Sign in"
    texts = [FRENCH, GERMAN, ENGLISH, f"{FRENCH}\n{GERMAN}\n{ENGLISH}\n{menu}", menu + "\n" + "word " * 30, "a >> b >> " * 4, (ENGLISH + " ") * 1, " ".join(f"w{i}" for i in range(60_000)), f"{ENGLISH}\n{ENGLISH}"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality_rules.judge(df)
    assert same(out.drop("text", "source"), duck(quality_rules.ORACLE, documents=("doc_id BIGINT, text VARCHAR, source VARCHAR", rows)))
    got = {r.doc_id: r for r in out.collect()}
    for i in (0, 1, 2, 6, 7):
        assert got[i].kept and got[i].lost_chars == 0 and got[i].n_failed_lines == 0
    assert got[3].kept and got[3].n_failed_lines == 4 and got[3].lost_chars == len(menu) - 3
    assert got[4].n_failed_lines == 4 and got[8].n_dup_lines == 1


def test_licences(spark, duck):
    rows, df = documents(spark)
    files = df.select("doc_id", F.expr(licences.PATH_SQL.format(div="div")).alias("path"), "text", F.lit(1).alias("licence"))
    out = licences.scan(files, keep=("doc_id",))
    want = duck(licences.ORACLE, documents=("doc_id BIGINT, text VARCHAR, source VARCHAR", rows))
    assert same(out, want) and {"header", "inherited"} <= {w["origin"] for w in want}
    odd = spark.createDataFrame([(None, "MIT License"), ("LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c.py", None), ("a/COPYING", "Released under the MIT License."), ("z.py", "text"), ("z.py", "text")], "path string, text string")
    got = sorted((str(r.path), r.licence, r.origin, r.from_dir) for r in licences.scan(odd).collect())
    assert got == [("LICENSE", "Apache-2.0", "file", None), ("None", None, None, None), ("a/COPYING", "MIT", "file", None), ("a/b/c.py", "MIT", "inherited", "a"), ("z.py", "Apache-2.0", "inherited", ""), ("z.py", "Apache-2.0", "inherited", "")]
    assert licences.scan(odd.limit(0)).count() == 0


def test_real_notices_get_their_own_licence(spark):
    two = licences._BSD_TWO + licences._BSD_END
    files = [
        ("a.py", "# SPDX-License-Identifier: MIT", "MIT"), ("b.py", "// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("c.md", "This page is CC BY-SA 4.0 licensed.", "CC-BY-SA-4.0"),
        ("d.md", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"), ("e.c", "This library is free software; it is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("f.c", "You can redistribute it under the terms of the GNU Affero General Public License, version 3", "AGPL-3.0"), ("g.js", "Released under the ISC License.", "ISC"), ("h/LICENSE", "Copyright 2020 X\n" + two, "BSD-2-Clause"),
        ("i/LICENSE", licences._BSD_TWO + "3. " + licences._BSD_NAMES + licences._BSD_END, "BSD-3-Clause"), ("j/LICENSE", "MIT License\n\nCopyright (c) 2021 Y\n\n" + licences._MIT_TEXT, "MIT"), ("k.go", "Released under the Example Affero License.", None),
    ]
    found = licences.scan(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()
    got = {r.path: r.licence if r.origin in ("header", "file") else None for r in found}
    assert {p: got[p] for p, _, want in files} == {p: want for p, _, want in files}


def test_native_plans_hold_no_python(spark):
    _, df = documents(spark)
    for frame in (quality_rules.judge(df), licences.scan(df.select(F.col("source").alias("path"), "text"))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# -- pipeline --


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    words = "the quiet house stood by a lake where boats lay still in the morning light and birds sang".split()
    rows = []
    for i in range(240):
        text = list(rng.choice(words, 40))
        if i % 8 == 0:
            text[3], text[20], text[33] = "idiot", "scum", "moron"
        rows.append((i, " ".join(text) if i % 6 else " | ".join(w + "%%%" for w in text), "en", "s", 0))
    rows += [(500, rows[1][1], "en", "s", 0), (501, rows[1][1] + " end", "en", "s", 0), (502, None, "en", "s", 0), (503, "", "en", "s", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).withColumn("score", F.lit(7)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {500, 501} and 1 in ids
    wrong = [i for i in range(240) if (i in ids) != (i % 6 != 0 and i % 8 != 0)]
    assert len(wrong) < 12
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
