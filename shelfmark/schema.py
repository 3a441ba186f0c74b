"""Schemas of the catalog tables and of the parsed document metadata."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# `batch` names the ingest run whose rows are the archive's current content
# (NULL until the first one commits), `content` the run that read that content:
# compaction moves rows to another run and leaves their content; `shared_ids`
# says that one of its book ids is also claimed by another archive.
ARCHIVES = _struct(name=_STRING, status=_STRING, batch=_LONG, content=_LONG, shared_ids=T.BooleanType())

AUTHOR_FIELDS = ("first_name", "middle_name", "last_name", "nickname")

# A book carries its authors under the names that the catalog shows, so a page needs no join.
BOOKS = _struct(
    id=_LONG,
    title=_STRING,
    genres=T.ArrayType(_STRING),
    date=_STRING,
    lang=_STRING,
    file_size=_LONG,
    sequence=_STRING,
    archive=_STRING,
    authors=T.ArrayType(_struct(id=_STRING, **dict.fromkeys(AUTHOR_FIELDS, _STRING))),
)
AUTHORS = _struct(id=_STRING, first_name=_STRING, middle_name=_STRING, last_name=_STRING, nickname=_STRING)
LINKS = _struct(book_id=_LONG, author_id=_STRING, pos=_INT, archive=_STRING)
INGEST_LOG = _struct(archive=_STRING, entry=_STRING, level=_STRING, message=_STRING)

# Least and greatest book id of each file of a run.
ZONES = _struct(file=_STRING, least=_LONG, greatest=_LONG)
# Length and time that an archive had when its directory was kept.
DIRECTORIES = _struct(archive=_STRING, length=_LONG, modified=T.TimestampType())

# An index segment holds the books of some contents; (archive, content) says
# whether the index still serves a row.
SEARCH_DOCS = _struct(
    id=_LONG, title=_STRING, genres_text=_STRING, authors_text=_STRING, sequence=_STRING, len=_LONG, archive=_STRING, content=_LONG
)
POSTINGS = _struct(term=_STRING, doc_id=_LONG, tf=_LONG, len=_LONG, archive=_STRING, content=_LONG)
# Additive: document frequencies by archive, and how many books it has of how many words.
TERM_STATS = _struct(term=_STRING, archive=_STRING, content=_LONG, df=_LONG)
LENGTHS = _struct(archive=_STRING, content=_LONG, docs=_LONG, words=_LONG)
# By term and range of ids what bounds a score there: the greatest frequency and the least length.
BLOCKS = _struct(term=_STRING, block=_LONG, most_tf=_LONG, least_len=_LONG)
# What an index version serves, and the segments it is made of with the contents they cover.
SERVED = _struct(name=_STRING, content=_LONG, shared_ids=T.BooleanType())
SEGMENTS = _struct(segment=_LONG, content=_LONG, size=_LONG)

STATUS_INDEXING, STATUS_INDEXED, STATUS_NEW = "indexing", "indexed", "new"
MAX_BOOK_ID = 2**32 - 1

_TEXTS = T.ArrayType(_STRING)


def _elements(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name.replace("_", "-"), kind) for name, kind in kinds.items()])


# The part of a document's <description> that the catalog keeps; series, which
# nest, are read from its text.
DESCRIPTION = T.StructType(
    [
        *_elements(
            title_info=T.ArrayType(
                _elements(
                    genre=_TEXTS,
                    author=T.ArrayType(
                        _elements(
                            first_name=_TEXTS,
                            middle_name=_TEXTS,
                            last_name=_TEXTS,
                            nickname=_TEXTS,
                            id=_STRING,
                        )
                    ),
                    book_title=_TEXTS,
                    date=_TEXTS,
                    lang=_TEXTS,
                )
            ),
            publish_info=T.ArrayType(_elements(year=_TEXTS)),
            document_info=T.ArrayType(_elements(date=_TEXTS)),
        ).fields,
        T.StructField("_corrupt_record", _STRING),
    ]
)
