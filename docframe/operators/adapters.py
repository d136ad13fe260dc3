"""Recognition engines as adapters, and the page pipeline around them.

An adapter is a Python object with recognize(content, params).  It runs in an
Arrow pass over the pages that the cache doesn't hold, after all filters, so
that no paid call is made for a page that needs none; a call's failure is a
value of its row, not the end of the job.
"""

from __future__ import annotations

import base64
import contextlib
import html
import json
import re
import subprocess
import tempfile
import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from docframe.functions import text as X
from docframe.functions.udf import decoded, markers, repaired, seq_ratio
from docframe.operators import control as C
from docframe.operators.control import assemble
from docframe.operators.lines import resolver_queue
from docframe.operators.numeric import resolver_result
from docframe.operators.runs import parsed_values_text, reply_text, reviewed
from docframe.operators.verify import second_pass_gate, text_metrics, verify
from docframe.session import kept, shared_folder
from docframe.sources.payloads import strip_fence


#: Words (or pages) that a task holds at most before it hands its pages on, and those of one page.
WORDS = 10_000


class Adapter(Protocol):
    def recognize(self, content: bytes, params: dict) -> dict:
        """text, and words as a list of {text, box, confidence}."""


_REGISTRY: dict[str, Callable[[], Adapter]] = {}


def register(kind: str, make: Callable[[], Adapter]) -> None:
    """Names a maker of adapters; it must be importable by the workers."""
    _REGISTRY[kind] = make


def maker(kind: str) -> Callable[[], Adapter]:
    """The maker of a named adapter."""
    if kind not in _REGISTRY:
        raise KeyError(f"no engine '{kind}'; known: {', '.join(sorted(_REGISTRY)) or 'none'}")
    return _REGISTRY[kind]


class Unusable(ValueError):
    """A reply that no retry mends."""


class Remote:
    """An adapter of a paid engine: `send` takes model, content and parameters and gives the reply's JSON text.

    Passing failures are tried again after a growing pause; after two rate limits in a row the next model of the chain is
    asked; a refused region or an unusable reply ends the call at once.  What pauses is a parameter, so tests don't wait."""

    def __init__(self, send: Callable[[str, bytes, dict], str], models: list[str], dialect: str = "gemini", attempts: int = 4, pause: Callable[[float], None] = time.sleep):
        self.send, self.models, self.dialect, self.attempts, self.pause = send, models, dialect, attempts, pause
        self.usage: dict = {}

    def recognize(self, content: bytes, params: dict) -> dict:
        at, streak, tried = 0, 0, 0
        while True:
            tried += 1
            try:
                reply = self.send(self.models[at], content, params)
                return {"text": self._text(reply), "model": self.models[at], "words": []}
            except Unusable:
                raise
            except Exception as e:  # noqa: BLE001 - told apart by name and message, as engines' libraries differ
                message, name = str(e).lower(), type(e).__name__.lower()
                has = lambda marks: any(m in message for m in marks)  # noqa: B023, E731
                if has(C.REGION_MARKS + C.REGION_MORE[self.dialect]) or tried >= self.attempts * len(self.models):
                    raise
                if has(C.RATE_MARKS[self.dialect]):
                    streak += 1
                    if streak >= 2 and at + 1 < len(self.models):
                        at, streak = at + 1, 0
                    self.pause(min(60.0, 10.0 * 1.7 ** max(0, streak - 1)))
                elif has(C.TRANSIENT_MARKS[self.dialect] + C.TRANSPORT_MARKS[self.dialect]) or any(m in name for m in C.TRANSPORT_NAMES[self.dialect]):
                    streak = 0
                    self.pause(min(20.0, 2.0 ** (tried - 1)))
                else:
                    raise

    def _text(self, reply: str) -> str:
        text = reply_text(reply).strip()
        if not text:
            raise TimeoutError("empty model response text")
        if "\ufffd" in text or markers(text) >= 3:
            raise Unusable("the reply's characters are broken")
        with contextlib.suppress(ValueError, AttributeError):
            self.usage = json.loads(reply).get("usage") or {}
        return text


class Fallback:
    """Asks a second adapter for all later pages once the first one's provider refuses the region."""

    def __init__(self, first: Adapter, second: Adapter):
        self.first, self.second, self.refused = first, second, False

    def recognize(self, content: bytes, params: dict) -> dict:
        if not self.refused:
            try:
                return self.first.recognize(content, params)
            except Exception as e:  # noqa: BLE001
                if not any(m in str(e).lower() for m in C.REGION_MARKS + C.REGION_MORE["gemini"]):
                    raise
                self.refused = True
        return self.second.recognize(content, params)


class Refining:
    """A first reading, then a second request with the draft in its prompt; an empty refinement keeps the draft."""

    def __init__(self, adapter: Adapter, prompt: str = "{draft}"):
        self.adapter, self.prompt = adapter, prompt

    def recognize(self, content: bytes, params: dict) -> dict:
        draft = self.adapter.recognize(content, params)
        better = self.adapter.recognize(content, params | {"prompt": self.prompt.replace("{draft}", draft["text"])})
        return draft | {"draft": draft["text"], "text": better["text"].strip() or draft["text"]}


class Replay:
    """An adapter that gives the stored reply of each page: for tests, and for payloads that were made elsewhere."""

    def __init__(self, replies: dict[str, dict]):
        self.replies = replies

    def recognize(self, content: bytes, params: dict) -> dict:
        import hashlib

        return self.replies[hashlib.sha256(content).hexdigest()]


def cache_key(content: str, engine: str, params: dict) -> F.Column:
    """The key of a result: the page's bytes, the engine, and its settings as sorted JSON."""
    settings = json.dumps(params, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return F.sha2(F.concat_ws("\x1f", F.sha2(content, 256), F.lit(engine), F.lit(settings)), 256)


def recognize(pages: DataFrame, make: Callable[[], Adapter], params: dict, key: str = "key", content: str = "content") -> DataFrame:
    """key, ok, text, words and error of each page."""
    word = T.StructType().add("text", "string").add("box", T.ArrayType(T.IntegerType())).add("confidence", "double")
    kind = T.StructType().add(key, "string").add("ok", "boolean").add("text", "string").add("words", T.ArrayType(word)).add("error", "string")
    kinds = to_arrow_schema(kind)

    def work(batches):
        adapter, names, out, size = make(), [key, "ok", "text", "words", "error"], [], 0
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                k, data = k.as_py(), data.as_py()
                try:
                    got = adapter.recognize(bytes(data), params)
                    words = [{"text": w["text"], "box": list(w["box"]), "confidence": float(w.get("confidence", 1.0))} for w in got.get("words", []) if w.get("box")]
                    out.append((k, True, got.get("text", ""), words, None))
                    size += len(words)
                except Exception as e:  # noqa: BLE001 - whatever an engine raises belongs to its page
                    out.append((k, False, None, [], f"{type(e).__name__}: {e}"[:500]))
                # Words take many times their room as Python objects, so pages are handed on by the number of words.
                if size >= WORDS or len(out) >= WORDS:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=kinds)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=kinds)

    return pages.select(key, content).mapInArrow(work, kind)


def run_pages(pages: DataFrame, cache: DataFrame, engine: str, make: Callable[[], Adapter], params: dict, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Results of all pages, and the new ones among them for the cache: equal pages are recognised once.

    New results are written to the shared folder before they are used, so each call is made once however often they are read."""
    keyed = pages.withColumn("key", cache_key(content, engine, params))
    misses = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    new = kept(recognize(misses, make, params, content=content), shared_folder(pages.sparkSession), "new")
    known = cache.unionByName(new.where("ok").select(*cache.columns), allowMissingColumns=True)
    return keyed.drop(content).join(known, "key", "left"), new


def local_pass(pages: DataFrame, make: Callable[[], Adapter], params: dict, engine: str = "tesseract", key: str = "key", content: str = "content") -> DataFrame:
    """A second reading of every page by a local engine: key and second_pass (ok, engine, text, words_count, error)."""
    read = recognize(pages, make, params, key, content)
    fields = F.struct("ok", F.lit(engine).alias("engine"), "text", F.when(F.col("ok"), F.size("words")).alias("words_count"), "error")
    return read.select(key, fields.alias("second_pass"))


def second_pass(results: DataFrame, make: Callable[[], Adapter], params: dict, scope: str = "suspicious", threshold: float = 0.90, key: str = "key", content: str = "content") -> DataFrame:
    """A second engine's reading of the pages that need one, and its agreement with the first.

    results: key, content, text and verification (struct of status and verified, or null).  Pages that pass keep the reason
    for which they were skipped; only the others are sent, in a pass of their own."""
    v = F.col("verification")
    gate = second_pass_gate(F.lit(scope), v.isNotNull(), v["status"], v["verified"], F.col("text"))
    gated = results.withColumn("_g", gate)
    open_ = gated.where("_g.run")
    read = kept(recognize(open_, make, params, key, content), shared_folder(results.sparkSession), "second")
    both = open_.select(key, F.col("text").alias("_first")).join(read.where("ok").select(key, F.col("text").alias("_second")), key)
    agreed = verify(both, "_first", "_second", key, threshold).select(key, F.col("status").alias("second_status"), "numeric_agreement", "text_jaccard")
    told = read.select(key, F.col("ok").alias("second_ok"), F.col("text").alias("second_text"), F.col("error").alias("second_error"))
    joined = gated.join(told, key, "left").join(agreed, key, "left")
    return joined.select(*results.columns, (~F.col("_g.run")).alias("skipped"), F.col("_g.reason").alias("reason"), F.coalesce("second_ok", ~F.col("_g.run")).alias("second_ok"), "second_text", "second_error", "second_status", "numeric_agreement", "text_jaccard")


def review_pass(results: DataFrame, make: Callable[[], Adapter], params: dict, key: str = "key", content: str = "content") -> DataFrame:
    """Pages whose text has signs of a bad recognition are read again; the review takes the draft's place unless it changes too much."""
    flagged = results.withColumn("flags", X.quality_flags("text"))
    open_ = flagged.where((F.size("flags") > 0) & (F.trim("text") != ""))
    read = kept(recognize(open_, make, params, key, content), shared_folder(results.sparkSession), "reviews").select(key, F.col("text").alias("_review"), F.col("error").alias("_error"))
    rated = open_.join(read, key).withColumn("_draft", F.trim("text")).withColumn("_similar", seq_ratio(F.trim("text"), F.trim(F.coalesce("_review", F.lit("")))))
    judged = rated.withColumn("_r", reviewed(F.col("_draft"), F.col("_review"), F.col("_similar"), F.col("flags")))
    done = judged.select(key, F.col("_r.text").alias("_text"), F.col("_r.applied").alias("_applied"), F.col("_r.change_ratio").alias("change_ratio"), F.coalesce("_error", "_r.error").alias("review_error"))
    joined = flagged.join(done, key, "left")
    applied = F.coalesce("_applied", F.lit(False))
    columns = [F.coalesce("_text", "text").alias("text") if c == "text" else F.col(c) for c in results.columns]
    return joined.select(*columns, "flags", F.when(applied, F.col("text")).alias("raw_text"), applied.alias("review_applied"), "change_ratio", "review_error")


def upgraded(cached: DataFrame, markdown: Column, threshold: float = 0.90, key: str = "key") -> DataFrame:
    """Cached results brought up to date without a call: text from the provider's page where that gives any, and the verification
    against a stored second reading computed anew."""
    fresh = cached.withColumn("_new", F.coalesce(F.nullif(markdown, F.lit("")), F.col("text"))).drop("text").withColumnRenamed("_new", "text")
    agreed = verify(fresh.where("second_text is not null"), "text", "second_text", key, threshold).select(key, F.col("status").alias("_status"), F.col("numeric_agreement").alias("_agreement"))
    joined = fresh.join(agreed, key, "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).withColumn("numeric_agreement", F.coalesce("_agreement", "numeric_agreement")).drop("_status", "_agreement")


def numeric_checks(candidates: DataFrame, make: Callable[[], Adapter], params: dict, key: str = "id", content: str = "crop") -> DataFrame:
    """Every candidate's crop read by a verifying engine: key, status and both digit sequences.  Candidates that no locator found
    (kind vision_page) come as whole pages, with an empty text."""
    read = kept(recognize(candidates, make, params, key, content), shared_folder(candidates.sparkSession), "checks")
    joined = candidates.join(read.select(key, "ok", F.col("text").alias("_reply"), "error"), key)
    said = parsed_values_text(F.col("_reply"), F.col("_reply"))
    located, verified = X.digit_sequences(F.col("text")), X.digit_sequences(said)
    status = F.when(~F.col("ok"), "error").otherwise(X.comparison_status(F.coalesce(F.col("_reply"), F.lit("")), located, verified))
    return joined.select(key, status.alias("status"), located.alias("located"), verified.alias("verified"), "error")


def resolve_crops(items: DataFrame, make: Callable[[], Adapter] | None, mode: str = "suggest", limit: int = -1, by: str = "run_id", order: str = "item_id", content: str = "crop") -> DataFrame:
    """Review items with the outcome of a repair-only engine: status, visible, confidence and safe.

    mode: off (nothing is sent), suggest, or auto-fix-safe (only then may a repair be marked as safe).  Without an engine items are
    queued for one.  Items without a crop, of missing engines, and beyond the limit aren't sent; each crop that is sent costs one call."""
    empty = items.withColumns({"status": F.lit("disabled" if mode == "off" else "queued_for_engine"), "visible": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "safe": F.lit(False)})
    if mode == "off" or make is None:
        return empty.drop(content)
    queued = resolver_queue(items.withColumn("has_crop", F.col(content).isNotNull()), limit, by, order).drop("has_crop").withColumn("_key", F.concat_ws("/", F.col(by).cast("string"), F.col(order).cast("string")))
    read = kept(recognize(queued.where("status = 'attempt'"), make, {}, "_key", content), shared_folder(items.sparkSession), "crops")
    reply = F.from_json(strip_fence(F.col("text")), "visible_text string, confidence string, reason string, safe_to_autofix boolean")
    told = read.select("_key", "ok", reply.alias("r")).join(queued.select("_key", "kind"), "_key")
    result = resolver_result(told.select("_key", "ok", "kind", F.col("r.visible_text").alias("visible"), F.col("r.confidence").alias("confidence"), F.coalesce("r.safe_to_autofix", F.lit(False)).alias("safe")))
    safe = F.col("safe") & F.lit(mode == "auto-fix-safe")
    status = F.when(~F.col("ok"), "resolver_error").when(safe, "safe_autofix_candidate").when(F.col("visible").isNotNull(), "resolved_review").otherwise("unresolved_review")
    done = result.select("_key", status.alias("_status"), "visible", "confidence", safe.alias("safe"))
    joined = queued.join(done, "_key", "left")
    return joined.select(*[c for c in items.columns if c != content], F.coalesce("_status", "status").alias("status"), "visible", "confidence", F.coalesce("safe", F.lit(False)).alias("safe"))


def quality_runs(pages: DataFrame, engines: dict[str, Callable[[], Adapter]], variants: dict[str, str], params: dict, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Text metrics of every page by every engine and variant, and the engines that can't be made, with their errors.

    variants: the column that holds each variant's image."""
    results, missing = None, []
    for engine, make in engines.items():
        try:
            make()
        except Exception as e:  # noqa: BLE001 - an engine that isn't there is a line of the report
            missing.append((engine, f"{type(e).__name__}: {e}"))
            continue
        for variant, column in variants.items():
            read = recognize(pages, make, params, key, column).select(key, F.lit(engine).alias("engine"), F.lit(variant).alias("variant"), "ok", F.coalesce("text", F.lit("")).alias("text"), "error")
            results = read if results is None else results.unionByName(read)
    errors = pages.sparkSession.createDataFrame(missing, "engine string, error string")
    return (None if results is None else text_metrics(kept(results, shared_folder(pages.sparkSession), "runs"))), errors


def collected_batch(output: DataFrame, requests: DataFrame, state: str) -> DataFrame:
    """Replies of a finished batch job with their pages: rows of JSON lines (key and response or error) joined to the requests.

    Nothing is taken from a job that isn't done; jobs that failed give no rows."""
    if state not in ("JOB_STATE_SUCCEEDED", "completed"):
        return assemble(output.sparkSession.createDataFrame([], "key string, text string, error string"), requests)
    line = F.col("line")
    body = F.get_json_object(line, "$.response")
    parts = F.from_json(F.get_json_object(body, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    text = F.coalesce(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), F.get_json_object(body, "$.text"))
    key = F.coalesce(F.get_json_object(line, "$.key"), F.get_json_object(line, "$.metadata.key"))
    return assemble(output.where(F.trim(line) != "").select(key.alias("key"), text.alias("text"), F.get_json_object(line, "$.error").alias("error")), requests)


def program(command: list[str], timeout: float = 180.0) -> Callable[[bytes, dict], str]:
    """Runs a program on a page: the image goes to a file that it is given for {image}, parameters for {name}; what it prints is the reply."""

    def run(content: bytes, params: dict) -> str:
        with tempfile.NamedTemporaryFile(suffix=".png") as image:
            image.write(content)
            image.flush()
            filled = [part.format_map({"image": image.name, **params}) for part in command]
            done = subprocess.run(filled, capture_output=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(done.stderr.decode("utf-8", "replace").strip()[-300:] or f"ended with {done.returncode}")
        return decoded(done.stdout)

    return run


def _clean_word(text: str) -> str:
    """A word without a quote that stands on one side only."""
    text = text.strip()
    if text.startswith('"') != text.endswith('"') or text == '"':
        text = text.strip('"').strip()
    return text


class Listing:
    """An adapter of an engine that lists words with their boxes in tab-separated rows (`run` gives the listing of a page)."""

    def __init__(self, run: Callable[[bytes, dict], str]):
        self.run = run

    def recognize(self, content: bytes, params: dict) -> dict:
        words, lines = [], {}
        for row in self.run(content, params).replace("\r", "").split("\n")[1:]:
            part = row.split("\t", 11)
            if len(part) < 12 or part[0] != "5":
                continue
            try:
                place, box, conf = tuple(map(int, part[2:5])), list(map(int, part[6:10])), float(part[10])
            except ValueError:
                continue
            text = _clean_word(part[11])
            if text and conf >= 0:
                words.append({"text": text, "box": box, "confidence": conf / 100})
                lines.setdefault(place, []).append(text)
        return {"text": "\n".join(" ".join(x) for x in lines.values()), "words": words}


class Blocks:
    """An adapter of a layout engine whose reply is JSON of blocks (text or html, polygon, reading_order, label, confidence)."""

    def __init__(self, run: Callable[[bytes, dict], str]):
        self.run = run

    def recognize(self, content: bytes, params: dict) -> dict:
        reply = json.loads(self.run(content, params))
        words, texts = [], []
        for block in sorted(reply.get("blocks") or [], key=lambda b: b.get("reading_order") or 0):
            text = (block.get("text") or _plain(block.get("html") or "")).strip()
            if not text:
                continue
            label = str(block.get("label") or "").lower()
            texts.append(f"## {text}" if "header" in label or label == "title" else text)
            points = block.get("polygon") or []
            if points:
                xs, ys = [int(p[0]) for p in points], [int(p[1]) for p in points]
                words.append({"text": text, "box": [min(xs), min(ys), max(1, max(xs) - min(xs)), max(1, max(ys) - min(ys))], "confidence": block.get("confidence") or 1.0})
        return {"text": "\n\n".join(texts), "words": words}


def _plain(markup: str) -> str:
    """Block markup as lines: cells are parted by tabs."""
    markup = re.sub(r"(?i)</t[dh]>", "\t", markup)
    markup = re.sub(r"(?i)</(?:p|div|tr|li|h[1-6]|table)>|<br\s*/?>", "\n", markup)
    lines = (" ".join(x.split()) for x in html.unescape(re.sub(r"<[^>]+>", "", markup)).split("\n"))
    return "\n".join(x for x in lines if x)


class Vertices:
    """An adapter of a service whose reply is JSON of blocks, lines and words with the corners of their boxes."""

    def __init__(self, send: Callable[[bytes, dict], str]):
        self.send = send

    def recognize(self, content: bytes, params: dict) -> dict:
        reply = json.loads(self.send(content, params))
        page = reply.get("textAnnotation") or (reply.get("result") or {}).get("textAnnotation") or {}
        words, lines = [], []
        for line in (x for block in page.get("blocks") or [] for x in block.get("lines") or []):
            lines.append(line.get("text") or "")
            for word in line.get("words") or []:
                corners = (word.get("boundingBox") or {}).get("vertices") or []
                xs, ys = ([int(float(c.get(k) or 0)) for c in corners] for k in "xy")
                if xs:
                    words.append({"text": word.get("text") or "", "box": [min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)], "confidence": 1.0 if word.get("confidence") is None else float(word["confidence"])})
        return {"text": page.get("markdown") or "\n".join(lines) or page.get("fullText") or "", "words": words}


class MarkdownPages:
    """An adapter of a service whose reply is JSON of pages in Markdown with blocks and tables; the page itself is handed on for its layout
    (sources.payloads.regions and page_markdown read it).  Replies with broken characters are refused."""

    def __init__(self, send: Callable[[bytes, dict], str]):
        self.send = send

    def recognize(self, content: bytes, params: dict) -> dict:
        pages = json.loads(self.send(content, params)).get("pages") or []
        if not pages:
            raise Unusable("the reply has no page")
        text = repaired(str(pages[0].get("markdown") or "").strip())
        if not text or "\ufffd" in text:
            raise Unusable("the reply's text is empty or broken")
        return {"text": text, "words": [], "page": pages[0]}


class Service:
    """An adapter of an engine that runs as a service of its own: `post` takes a path and a JSON object and gives one."""

    def __init__(self, post: Callable[[str, dict], dict], path: str = "/ocr"):
        self.post, self.path = post, path

    def recognize(self, content: bytes, params: dict) -> dict:
        reply = self.post(self.path, {"image": base64.b64encode(content).decode(), "params": params})
        if "error" in reply:
            raise RuntimeError(str(reply["error"]))
        return {"text": reply.get("text", ""), "words": reply.get("words", [])}

    def ready(self) -> bool:
        """Whether the service answers."""
        try:
            return bool(self.post("/health", {}).get("ok"))
        except Exception:  # noqa: BLE001 - any failure means that it isn't
            return False


_WARM: dict[str, Adapter] = {}


def warm(name: str, make: Callable[[], Adapter]) -> Callable[[], Adapter]:
    """A maker whose adapter is made once in a worker and kept for its later tasks: for engines that take long to start."""

    def get() -> Adapter:
        if name not in _WARM:
            _WARM[name] = make()
        return _WARM[name]

    return get


def smoke(engines: dict[str, Callable[[], Adapter]], image: bytes, params: dict | None = None) -> list[dict]:
    """One page through every engine: name, ok, the number of characters read, or what went wrong."""
    out = []
    for name, make in sorted(engines.items()):
        try:
            text = make().recognize(image, params or {}).get("text", "")
            out.append({"engine": name, "ok": bool(text.strip()), "chars": len(text), "error": None if text.strip() else "no text"})
        except Exception as e:  # noqa: BLE001 - what an engine raises is its line of the report
            out.append({"engine": name, "ok": False, "chars": 0, "error": f"{type(e).__name__}: {e}"})
    return out


class TextPages:
    """An adapter for pages that are text already: their bytes as UTF-8, each word with a box by its place in its line."""

    def recognize(self, content: bytes, params: dict) -> dict:
        text = content.decode("utf-8").translate(str.maketrans(params.get("exchange", {})))
        words = [{"text": w, "box": [x, y, len(w), 1]} for y, line in enumerate(text.split("\n")) for x, w in enumerate(line.split())]
        return {"text": text, "words": words}


register("text", TextPages)
