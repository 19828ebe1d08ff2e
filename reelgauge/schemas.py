"""Declared schemas. Missing values are always SQL NULL."""

from pyspark.sql import types as T

from reelgauge.constants import FILM_CSV_HEADER

_TEXT = T.StringType()
_NUMBER = T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


METADATA_PAYLOAD = _struct(
    Response=_TEXT, Title=_TEXT, Released=_TEXT, BoxOffice=_TEXT, imdbRating=_TEXT,
    Actors=_TEXT, Director=_TEXT,
    Ratings=T.ArrayType(_struct(Source=_TEXT, Value=_TEXT)),
)

FILM_COLUMNS = (
    "title", "release_date", "box_office_raw", "box_office_adj", "imdb_rating",
    "rt_score_raw", "cast", "director", "budget", "star_power", "total_star_power",
    "sentiment_shift", "arc1_raw", "arc2_raw", "arc3_raw", "lexical_diversity",
    "named_themes", "dominant_topics", "indie_quality_score",
)
FILM_COLUMN_OF_HEADER = dict(zip(FILM_CSV_HEADER, FILM_COLUMNS, strict=True))

FILM_CSV = T.StructType([T.StructField(name, _TEXT) for name in FILM_CSV_HEADER])

FILM = _struct(
    title=_TEXT, release_date=_TEXT, box_office_raw=_TEXT, box_office_adj=_NUMBER,
    imdb_rating=_NUMBER, rt_score_raw=_TEXT, cast=_TEXT, director=_TEXT, budget=_NUMBER,
    star_power=T.MapType(_TEXT, _NUMBER), total_star_power=_NUMBER,
    sentiment_shift=_NUMBER, arc1_raw=_TEXT, arc2_raw=_TEXT, arc3_raw=_TEXT,
    lexical_diversity=_NUMBER, named_themes=_TEXT, dominant_topics=_TEXT,
    indie_quality_score=_NUMBER,
)

DIALOGUE = T.StructType([
    T.StructField("title", _TEXT),
    T.StructField("seq", T.IntegerType()),
    T.StructField("line_count", T.IntegerType()),
    T.StructField("character", _TEXT),
    T.StructField("line", _TEXT),
])

INDEX_SERIES = _struct(date=T.DateType(), value=_NUMBER)
