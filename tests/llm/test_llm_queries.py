"""Every registered query of the subpackage over whole tables of the smallest size, against SQL where there is some."""

import pytest

from tests.conftest import DATA, same_as_sql
from weftmark.llm import queries

SMALL = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SMALL.is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(SMALL))
    if name in queries.ORACLE:
        same_as_sql(df, queries.ORACLE[name], SMALL)
    else:
        assert df.count() > 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import weftmark

    root = Path(weftmark.__file__).parent
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not [p for p in others if "weftmark.llm" in p.read_text() or "from .llm" in p.read_text()]
