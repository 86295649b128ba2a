"""Fixed schema of every table. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _D, _TS, _F = (
    T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampType(), T.DoubleType(),
)
_LIST = T.ArrayType(T.StringType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FEED_ENTRIES = _schema(
    source=_S, seq=_L, title=_S, link=_S, summary=_S, description=_S, published=_S
)
ARTICLES_RAW = _schema(
    id=_L, title=_S, description=_S, url=_S, day=_D, source=_S, ingested_at=_TS
)
ARTICLES = _schema(
    id=_L, title=_S, description=_S, url=_S, day=_D, ingested_at=_TS, source=_S,
    topics=_LIST, score=_I, relevant=_I, risk=_I, opportunity=_I, persons=_LIST,
    orgs=_LIST, places=_LIST, geo_level=_S, region_id=_L, deep_analysis=_I,
)
TOPICS = _schema(id=_L, name=_S, description=_S, keywords=_S, active=_I)
REGIONS = _schema(id=_L, name=_S, name_norm=_S, kind=_S, country=_S, code=_S, is_target=_I)
ENTITIES = _schema(id=_L, name=_S, kind=_S, is_key=_I, category=_S)
ENTITY_ALIAS = _schema(entity_id=_L, alias=_S, is_primary=_I)
ARTICLE_TOPIC = _schema(article_id=_L, topic_id=_L, score=_L)
ARTICLE_ENTITY = _schema(article_id=_L, entity_id=_L, role=_S, freq=_L)
DAILY_GLOBAL = _schema(
    day=_D, n_articles=_L, n_relevant=_L, n_risk=_L, n_opportunity=_L, n_mixed=_L,
    n_sources=_L, n_deep=_L,
)
DAILY_TOPIC = _schema(
    day=_D, topic_id=_L, n_articles=_L, n_risk=_L, n_opportunity=_L, avg_score=_F
)
DAILY_REGION = _schema(
    day=_D, region_id=_L, geo_level=_S, n_articles=_L, n_risk=_L, n_opportunity=_L
)
DAILY_ENTITY = _schema(
    day=_D, entity_id=_L, mentions=_L, n_risk=_L, n_opportunity=_L, freq_total=_L
)
DAILY_SOURCE = _schema(
    day=_D, source=_S, n_articles=_L, n_relevant=_L, n_risk=_L, n_opportunity=_L
)
KEYWORDS = _schema(kind=_S, group=_S, term=_S, ord=_I)
MUNICIPALITIES = _schema(ord=_I, municipality=_S, subregion=_S)
FEEDS = _schema(name=_S, url=_S, kind=_S, region=_S, tags=_LIST)
GAZETTEER = _schema(surface=_S, kind=_S)
# dashboard export: every column is text until parsed leniently
DASHBOARD_CSV = _schema(
    id=_S, day=_S, source=_S, title=_S, url=_S, persons=_S, orgs=_S, places=_S,
    geo_level=_S, deep_analysis=_S, risk=_S, opportunity=_S, topics=_S,
)
MODEL_ANSWER = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", _L),
            T.StructField("personas", _LIST),
            T.StructField("organizaciones", _LIST),
            T.StructField("lugares", _LIST),
        ]
    )
)

REGION_KINDS = ("pais", "estado", "ciudad")
ENTITY_KINDS = ("PER", "ORG", "LOC", "MISC")
