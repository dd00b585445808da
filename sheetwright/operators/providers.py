"""Engines that read images: asked once for each distinct image, their replies turned into columns.

An engine is a function over a list of images (bytes), so any can be given;
none is part of this package. Replies are joined back by the image's hash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_json, strip
from ..rules import fixed

TextEngine = Callable[[list[bytes]], Sequence[str | None]]
#: Words as (text, left, top, width, height, confidence); the confidence may be a text.
WordEngine = Callable[[list[bytes]], Sequence[Sequence[tuple]]]


def image_hash(image: Column) -> Column:
    return F.substring(F.sha2(image, 256), 1, 16)


def _distinct(pages: DataFrame) -> DataFrame:
    return pages.where("image is not null").select(image_hash(F.col("image")).alias("image_hash"), "image").groupBy("image_hash").agg(F.first("image").alias("image"))


def read_text(pages: DataFrame, engines: dict[str, TextEngine]) -> DataFrame:
    """(image_hash, ocr_text, engine): the first engine, in order, that reads a text which isn't blank. An engine that fails reads nothing."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = b.column(1).to_pylist()
            texts: list[str | None] = [None] * len(images)
            names: list[str | None] = [None] * len(images)
            for name, engine in engines.items():
                open_ = [i for i, t in enumerate(texts) if t is None]
                if not open_:
                    break
                try:
                    found = engine([images[i] for i in open_])
                except Exception:  # noqa: BLE001  an engine's failure is no text
                    continue
                for i, t in zip(open_, found, strict=True):
                    if (t or "").strip():
                        texts[i], names[i] = t, name
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(names, pa.string())], names=["image_hash", "ocr_text", "engine"])

    return _distinct(pages).mapInArrow(ask, "image_hash string, ocr_text string, engine string")


def sure(confidence: Column, least: int = 60) -> Column:
    """Whether a word's confidence, a number or a text, is high enough; what is no number is 0."""
    return F.coalesce(F.expr("try_cast(confidence as int)") if confidence is None else confidence.try_cast("int"), F.lit(0)) >= least


def read_words(pages: DataFrame, engine: WordEngine, least: int = 60) -> DataFrame:
    """(image_hash, ord, text, x0, y0, x1, y1, confidence) of the words that an engine is sure of, blank ones left out."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, i, str(w[0]), *map(float, w[1:5]), str(w[5])) for h, words in zip(b.column(0).to_pylist(), engine(b.column(1).to_pylist()), strict=True) for i, w in enumerate(words)]
            types = [pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["image_hash", "ord", "text", "l", "t", "w", "h", "confidence"])

    d = _distinct(pages).mapInArrow(ask, "image_hash string, ord int, text string, l double, t double, w double, h double, confidence string")
    d = d.withColumn("text", strip(F.col("text"))).where((F.col("text") != "") & sure(F.col("confidence"), least))
    return d.select("image_hash", "ord", "text", F.col("l").alias("x0"), F.col("t").alias("y0"), (F.col("l") + F.col("w")).alias("x1"), (F.col("t") + F.col("h")).alias("y1"), F.coalesce(F.col("confidence").try_cast("int"), F.lit(0)).alias("confidence"))


def reply_value(reply: Column) -> Column:
    """A model's one-value reply: trimmed; null for a blank one and for UNKNOWN."""
    t = strip(reply)
    return F.when((t != "") & (F.upper(t) != "UNKNOWN"), t)


class Refused(RuntimeError):
    """An engine that refuses a call for now."""


class Limited:
    """A one-image engine as one of lists, with so many calls a minute at most.

    A refused call waits and is made once more; if that is refused too, the
    engine is off for good and answers nothing. Clock and sleep can be given.
    One object counts the calls of one worker.
    """

    def __init__(self, engine: Callable[[bytes], str | None], most: int = fixed.CALLS_A_MINUTE, backoff: Sequence[float] = fixed.CALL_BACKOFF, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.engine, self.most, self.backoff, self.clock, self.sleep = engine, most, backoff, clock, sleep
        self.calls: list[float] = []
        self.off = False

    def _turn(self) -> None:
        self.calls = [t for t in self.calls if self.clock() - t < 60]
        if len(self.calls) >= self.most:
            self.sleep(max(0.0, 60 - (self.clock() - min(self.calls))))
            self.calls = [t for t in self.calls if self.clock() - t < 60]
        self.calls.append(self.clock())

    def ask(self, image: bytes) -> str | None:
        for k in range(2):
            if self.off:
                return None
            self._turn()
            try:
                return self.engine(image)
            except Refused:
                self.sleep(self.backoff[k])
                self.off = k == 1
        return None

    def __call__(self, images: list[bytes]) -> list[str | None]:
        return [self.ask(x) for x in images]


def read_replies(pages: DataFrame, engine: TextEngine, known: DataFrame | None = None) -> DataFrame:
    """(image_hash, reply) of a model: known replies as they are, and new ones of images that have none.

    UNKNOWN and blank replies are null, and are known too, so no image is asked twice.
    """
    new = _distinct(pages)
    if known is not None:
        new = new.join(known.select("image_hash"), "image_hash", "left_anti")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(engine(b.column(1).to_pylist()), pa.string())], names=["image_hash", "reply"])

    out = new.select("image_hash", "image").mapInArrow(ask, "image_hash string, reply string").withColumn("reply", reply_value(F.col("reply")))
    return out if known is None else known.select("image_hash", "reply").unionByName(out)


def with_replies(pages: DataFrame, replies: DataFrame, out: str, value: str = "reply") -> DataFrame:
    """Pages with the value of their image's reply as ``out``."""
    r = replies.select(F.col("image_hash").alias("_hash"), F.col(value).alias(out))
    return pages.join(r, image_hash(F.col("image")) == F.col("_hash"), "left").drop("_hash")


_BOX = "bbox_percent struct<x1:double,y1:double,x2:double,y2:double>"
TELEMETRY = (
    f"page_1_is_cover_sheet boolean, page_1_analysis string, title_block struct<location:string,{_BOX.replace(' struct', ':struct')},confidence:double>, "
    f"zones map<string,struct<{_BOX.replace(' struct', ':struct')},text_orientation:string,contains:array<string>,confidence:double>>, "
    "layout_consistency struct<is_consistent:boolean,consistency_score:double>, warnings array<string>"
)


def telemetry(reply: Column) -> Column:
    """A model's description of a title block, with defaults for what it leaves out; null if the reply holds no JSON."""
    j = F.from_json(first_json(reply), TELEMETRY)
    box = lambda b, *d: F.struct(*[F.coalesce(b[k], F.lit(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), d, strict=True)])
    tb = j["title_block"]
    zones = F.transform_values(
        F.map_filter(F.coalesce(j["zones"], F.create_map().cast("map<string,struct<bbox_percent:struct<x1:double,y1:double,x2:double,y2:double>,text_orientation:string,contains:array<string>,confidence:double>>")), lambda _, z: z["bbox_percent"].isNotNull()),
        lambda _, z: F.struct(
            box(z["bbox_percent"], 0.0, 0.0, 1.0, 1.0).alias("box"), F.coalesce(z["text_orientation"], F.lit("horizontal")).alias("text_orientation"),
            F.coalesce(z["contains"], F.array().cast("array<string>")).alias("contains"), F.coalesce(z["confidence"], F.lit(0.0)).alias("confidence")),
    )
    return F.when(j.isNotNull(), F.struct(
        F.coalesce(j["page_1_is_cover_sheet"], F.lit(False)).alias("page_1_is_cover_sheet"), F.coalesce(j["page_1_analysis"], F.lit("")).alias("page_1_analysis"),
        F.coalesce(tb["location"], F.lit("bottom_right")).alias("location"), box(tb["bbox_percent"], 0.65, 0.70, 1.0, 1.0).alias("box"), F.coalesce(tb["confidence"], F.lit(0.0)).alias("confidence"), zones.alias("zones"),
        F.coalesce(j["layout_consistency"]["is_consistent"], F.lit(True)).alias("is_consistent"), F.coalesce(j["layout_consistency"]["consistency_score"], F.lit(0.0)).alias("consistency_score"),
        F.coalesce(j["warnings"], F.array().cast("array<string>")).alias("warnings"),
    ))


def with_border(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """Pages with their set's learned border: (x1, confidence), 0.85 and 0 where none was learned."""
    b = learned.select("pdf_filename", F.col("x1").alias("border"), F.col("confidence").alias("border_confidence"))
    return pages.join(b, "pdf_filename", "left").fillna({"border": 0.85, "border_confidence": 0.0})
