"""Classes and subjects found in a tree of folders, from the paths alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def class_of_folder(name: Column) -> Column:
    """The class a folder's name tells, in this order: X and 10, V and 5 (so that CLASS-VI gives 5), VI and 6, IX and 9; else NULL."""
    n = F.upper(name)
    says = lambda *parts: F.greatest(*[n.contains(p) for p in parts])
    return (
        F.when(says("CLASS-X", "CLASS-10"), 10).when(says("CLASS-V", "CLASS 5", "CLASS-5"), 5)
        .when(says("CLASS-VI", "CLASS 6", "CLASS-6"), 6).when(says("CLASS-IX", "CLASS 9", "CLASS-9"), 9)
    )


def subject_of_folder(name: Column) -> Column:
    """struct<subject, language, lang_code> of a folder 'Subject-...-Language'; NULL without a hyphen."""
    parts = F.split(name, "-")
    language = F.initcap(F.trim(F.element_at(parts, -1)))
    code = F.when(language.contains("Hindi"), "hi").when(language.contains("Urdu"), "ur").otherwise("en")
    return F.when(F.size(parts) >= 2, F.struct(F.initcap(F.trim(F.element_at(parts, 1))).alias("subject"), language.alias("language"), code.alias("lang_code")))


# Names a class's folder may have, the first that is there counts.
FOLDERS = {
    5: ("CLASS V", "CLASS-V", "class-v"), 6: ("CLASS-VI", "CLASS VI", "class-vi"), 9: ("CLASS-IX", "CLASS IX", "class-ix"), 10: ("CLASS-X", "CLASS-10", "class-x"),
}


def first_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """(class, path): the files .../class folder/subject folder/file below the first folder there is of each class."""
    nth = F.create_map(*[F.lit(x) for names in FOLDERS.values() for i, n in enumerate(names) for x in (n, i)])
    number = F.create_map(*[F.lit(x) for c, names in FOLDERS.items() for n in names for x in (n, c)])
    folder = F.try_element_at(F.split(F.col(path), "/"), F.lit(-3))
    found = paths.select(F.col(path).alias("path"), nth[folder].alias("nth"), number[folder].alias("class")).where("class is not null")
    return found.join(F.broadcast(found.groupBy("class").agg(F.min("nth").alias("nth"))), ["class", "nth"]).select("class", "path")


# Subjects on offer by class.
SUBJECTS = {
    5: ("Mathematics", "English", "Hindi", "Environmental Studies"),
    6: ("Mathematics", "Science", "English", "Hindi", "Social Science"),
    7: ("Mathematics", "Science", "English", "Hindi", "Social Science"),
    8: ("Mathematics", "Science", "English", "Hindi", "Social Science"),
    9: ("Mathematics", "Science", "English", "Hindi", "Social Science"),
    10: ("Mathematics", "Science", "English", "Hindi", "Social Science", "Health and Physical Science"),
}


def subjects(spark: SparkSession) -> DataFrame:
    """(class, subject): the subjects on offer, for lookups by class."""
    return spark.createDataFrame([(c, s) for c, names in SUBJECTS.items() for s in names], "class int, subject string")


def catalog(paths: DataFrame, path: str = "path") -> DataFrame:
    """(class, subject, language, lang_code, pdf_count) from file paths .../class folder/subject folder/file.pdf.

    The class is a column of paths where it is known (first_folders()), else it is told by the folder's name.
    """
    parts = F.split(F.col(path), "/")
    told = F.col("class") if "class" in paths.columns else class_of_folder(F.try_element_at(parts, F.lit(-3)))
    named = paths.select(told.alias("class"), F.try_element_at(parts, F.lit(-2)).alias("s"), F.try_element_at(parts, F.lit(-1)).alias("f"))
    found = named.where(F.lower("f").endswith(".pdf")).select("class", subject_of_folder(F.col("s")).alias("s"))
    return found.where("class is not null and s is not null").groupBy("class", "s.subject", "s.language", "s.lang_code").agg(F.count(F.lit(1)).alias("pdf_count"))


def pick_subject(found: DataFrame, class_number: int, subject: str, lang_code: str) -> DataFrame:
    """The first entry of a catalog, by subject and language, that matches whatever its case; no row where none does."""
    mine = (F.col("class") == class_number) & (F.lower("subject") == subject.lower()) & (F.col("lang_code") == lang_code.lower())
    return found.where(mine).orderBy("subject", "language").limit(1)


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of a tree on any file system; only paths are read, no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root).select("path")
    return catalog(files)
