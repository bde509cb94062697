"""File layouts: the header of each kind of CSV file, and the columns it is read into."""

from __future__ import annotations

from pyspark.sql import types as T

# Header names in file order.
POSTS = (
    "Id", "UserId", "Avatar", "Author", "Content", "Url",
    "ReactionsCount", "Depth", "SubCommentsCount", "CommentAt",
)
CLASSIFIED = ("Content", "ReactionsCount", "SubCommentsCount", "CommentAt", "stance", "confidence")
REPORT = (*CLASSIFIED, "sarcasm_label", "sarcasm_score", "explanation")
ANNOTATION = (*CLASSIFIED, "validation")
GOLD = ("text", "stance")

# Header name to column name and type. Unlisted headers are not used by any analysis.
COLUMNS = {
    "Author": ("author", "string"),
    "Content": ("content", "string"),
    "ReactionsCount": ("reactions", "bigint"),
    "SubCommentsCount": ("sub_comments", "bigint"),
    "CommentAt": ("comment_at", "string"),
    "stance": ("stance", "string"),
    "confidence": ("confidence", "double"),
    "sarcasm_label": ("sarcasm_label", "string"),
    "sarcasm_score": ("sarcasm_score", "double"),
    "explanation": ("explanation", "string"),
    "validation": ("validation", "string"),
    "text": ("text", "string"),
}

# What a stage adds to the name of a post's file.
FILE_SUFFIXES = ("_classified_comments", "_uncertainty_sarcasm_report", "_suspect_comments_explained")


def text_schema(header: tuple[str, ...]) -> T.StructType:
    """Every field as text; numbers are cast afterwards, so that a mangled one is just missing."""
    return T.StructType([T.StructField(name, T.StringType()) for name in header])


def comment_schema(header: tuple[str, ...]) -> T.StructType:
    """Columns of comments read from files with this header."""
    fields = ["post_id string", "ord bigint"]
    fields += [f"{name} {kind}" for name, kind in (COLUMNS[h] for h in header if h in COLUMNS)]
    return T._parse_datatype_string(", ".join(fields))
