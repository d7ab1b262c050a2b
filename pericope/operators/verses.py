"""The base relation: verses in canonical order, from nested documents or from flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pericope.functions.text import normalised

_VERSE = T.StructType([T.StructField("chapter", T.IntegerType()), T.StructField("verse", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])
_CHAPTER = T.StructType([T.StructField("chapter", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("verses", T.ArrayType(_VERSE))])
_BOOK = T.StructType([T.StructField("nr", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("chapters", T.ArrayType(_CHAPTER))])
METADATA = ("translation", "abbreviation", "lang", "language", "direction", "encoding")
TRANSLATION = T.StructType([*(T.StructField(x, T.StringType()) for x in METADATA), T.StructField("books", T.ArrayType(_BOOK))])
#: A chapter's file.
CHAPTER_FILE = T.StructType([*(T.StructField(x, T.StringType()) for x in METADATA), T.StructField("book_nr", T.IntegerType()), T.StructField("book_name", T.StringType()), *_CHAPTER.fields])
BOOKS_INDEX = T.MapType(T.StringType(), T.StructType([*(T.StructField(x, T.StringType()) for x in METADATA), T.StructField("nr", T.IntegerType()), T.StructField("name", T.StringType())]))


def flatten(translations: DataFrame) -> DataFrame:
    """Nested translations to (abbreviation, book_nr, book_name, chapter, chapter_name, verse, reference, text)."""
    b = translations.select("abbreviation", F.explode("books").alias("b"))
    c = b.select("abbreviation", F.col("b.nr").alias("book_nr"), F.col("b.name").alias("book_name"), F.explode("b.chapters").alias("c"))
    v = c.select("abbreviation", "book_nr", "book_name", F.col("c.chapter").alias("chapter"), F.col("c.name").alias("chapter_name"), F.explode("c.verses").alias("v"))
    return v.select("abbreviation", "book_nr", "book_name", "chapter", "chapter_name", F.col("v.verse").alias("verse"), F.col("v.name").alias("reference"), F.col("v.text").alias("text"))


def flatten_chapters(chapters: DataFrame) -> DataFrame:
    """The same from rows of chapter files."""
    c = chapters.select("abbreviation", "book_nr", "book_name", "chapter", F.col("name").alias("chapter_name"), F.explode("verses").alias("v"))
    return c.select("abbreviation", "book_nr", "book_name", "chapter", "chapter_name", F.col("v.verse").alias("verse"), F.col("v.name").alias("reference"), F.col("v.text").alias("text"))


def numbered(verses: DataFrame) -> DataFrame:
    """verses with ordinal: dense from 0 by book, chapter and verse within each abbreviation.

    The number is put together from the verses before the book, those before the
    chapter and the place in the chapter, so no step orders more than one
    chapter's verses, one book's chapters or one translation's books at once.
    """
    chapters = verses.groupBy("abbreviation", "book_nr", "chapter").agg(F.count(F.lit(1)).alias("n"))
    books = chapters.groupBy("abbreviation", "book_nr").agg(F.sum("n").alias("n"))

    def before(keys: list[str], by: str):
        return F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    first_of_book = books.select("abbreviation", "book_nr", before(["abbreviation"], "book_nr").alias("book_at"))
    first = chapters.select("abbreviation", "book_nr", "chapter", before(["abbreviation", "book_nr"], "chapter").alias("chapter_at")).join(first_of_book, ["abbreviation", "book_nr"])
    place = F.row_number().over(W.partitionBy("abbreviation", "book_nr", "chapter").orderBy("verse"))
    return verses.withColumn("place", place).join(first, ["abbreviation", "book_nr", "chapter"]).withColumn("ordinal", F.col("book_at") + F.col("chapter_at") + F.col("place") - 1).drop("place", "book_at", "chapter_at")


def from_documents(docs: DataFrame) -> DataFrame:
    """The driver's documents as verses: a language is a translation, a line a verse."""
    lines = docs.where("text is not null").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    book, chapter = F.expr("doc_id % 83 + 1").cast("int"), F.expr("doc_id div 83 + 1").cast("int")
    return lines.select(
        F.col("lang").alias("abbreviation"), book.alias("book_nr"), F.concat(F.lit("Book "), book).alias("book_name"), chapter.alias("chapter"),
        F.concat(F.lit("Book "), book, F.lit(" "), chapter).alias("chapter_name"), (F.col("at") + 1).alias("verse"),
        F.concat(F.lit("Book "), book, F.lit(" "), chapter, F.lit(":"), F.col("at") + 1).alias("reference"), "text",
    )


def from_conversations(turns: DataFrame) -> DataFrame:
    """The driver's conversations as verses of one book: a conversation is a chapter, a turn a verse."""
    chapter, verse = (F.col("conv_id") + 1).cast("int"), (F.col("turn") + 1).cast("int")
    return turns.select(
        F.lit("talk").alias("abbreviation"), F.lit(1).alias("book_nr"), F.lit("Talk").alias("book_name"), chapter.alias("chapter"), F.concat(F.lit("Talk "), chapter).alias("chapter_name"),
        verse.alias("verse"), F.concat(F.lit("Talk "), chapter, F.lit(":"), verse).alias("reference"), "text",
    )


def chapter_metadata(translations: DataFrame) -> DataFrame:
    """The metadata that every chapter carries."""
    return translations.select(*[c for c in METADATA if c in translations.columns])


def translation_metadata(translations: DataFrame) -> DataFrame:
    """Everything about a translation but its books."""
    return translations.drop("books")


def available_books(verses: DataFrame) -> DataFrame:
    return verses.select("abbreviation", "book_nr").distinct()


def book_names(verses: DataFrame) -> DataFrame:
    """(abbreviation, name, book_nr): of equal names, the book that comes last."""
    b = verses.groupBy("abbreviation", "book_nr").agg(F.max("book_name").alias("book_name"))
    name = F.regexp_replace(F.replace(normalised(F.col("book_name"), False, "insensitive"), F.lit("."), F.lit("")), r"\s+", "")
    return b.withColumn("name", name).groupBy("abbreviation", "name").agg(F.max("book_nr").alias("book_nr"))
