import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from newsignal.model import ARTICLES, COMPANIES, SCORES, News  # noqa: E402
from newsignal.operators.store import _nullable  # noqa: E402
from newsignal.session import local_session  # noqa: E402

AS_OF = datetime(2025, 11, 18, 12, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "newsignal-tests", str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


def table(spark, schema, rows):
    """Rows given as dicts; columns left out are NULL."""
    full = [tuple(row.get(f.name) for f in schema.fields) for row in rows]
    return spark.createDataFrame(full, _nullable(schema))


@pytest.fixture
def make_news(spark):
    """News from companies {name: sector} and (company, moment, score, confidence, …) rows."""
    def build(companies, rows):
        cs = [{"id": n, "name": n, "sector": s, "symbol": n[:2].upper()} for n, s in companies.items()]
        articles, scores = [], []
        for i, (company, moment, score, *more) in enumerate(rows):
            confidence, source, label = (*more, *(None,) * 3)[:3]
            articles.append({
                "id": str(i), "title": f"t{i}", "url": f"u{i}", "source": source or "s", "company_id": company,
                "published_at": moment, "published_date": moment.date(),
            })
            if score is None:
                continue
            value = Decimal(score)
            scores.append({
                "id": str(i), "article_id": str(i), "sentiment_score": value,
                "confidence": Decimal(confidence or "0.5"),
                "sentiment_label": label or ("positive" if value > 0 else "negative" if value < 0 else "neutral"),
                "processing_method": "combined", "published_date": moment.date(),
            })
        return News(table(spark, COMPANIES, cs), table(spark, ARTICLES, articles), table(spark, SCORES, scores))

    return build
