"""What a session keeps of a folder's tables, and when it lets go."""

import os
import shutil

from shelfspark.plans import queries
from shelfspark.sources import catalogue
from tests.oracle import SMALL


def test_changed_files_are_seen(spark, tmp_path):
    folder = tmp_path / "tables"
    shutil.copytree(SMALL, folder)
    os.chmod(folder, 0o755)
    path = f"file://{folder}"
    before = queries.QUERIES["q01_book_docs"](spark, path).count()
    cat = catalogue.catalogue(spark, path)
    assert catalogue.catalogue(spark, path) is cat and cat.persisted
    rows = spark.read.parquet(f"{path}/part.parquet").where("p_partkey >= 20").toPandas()
    (folder / "part.parquet").unlink()
    rows.to_parquet(folder / "part.parquet")
    assert queries.QUERIES["q01_book_docs"](spark, path).count() == before - 20
    assert catalogue.catalogue(spark, path) is not cat and not any(df.is_cached for df in cat.persisted)
    catalogue.release(spark, path)
    assert catalogue.catalogue(spark, path) is not cat
