import pathlib
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from edge_cases import DOCUMENTS, edge_rows, save, table  # noqa: E402


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    r = random.Random(4)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)], i) for i in range(60)]
    vectors += [(100 + i, [x + r.gauss(0, 0.05) for x in vectors[i % 3][1]], None) for i in range(30)] + [(200 + i, vectors[5][1], 0) for i in range(4)]
    vectors += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1), (304, [float("inf")] + [1.0] * 7, 1), (305, [], 1)]
    vectors += [(306, [1.0, 2.0], 1), (307, [1.0, 2.1], 1), (0, vectors[0][1], 0), (308, [x * 1e300 for x in vectors[7][1]], 1)]
    urls = ["http://a.example.net/en/x?y", "HTTPS://EXAMPLE.NET/en/", "http://example.net", "x://net/", "net/", None, "", "http://www.example.com/de/a#b", "http://m.org/fr/?q",
            "http://org/fr", "http://a.net:80/", "http:///x", "http://.net/a", "http://example.netx/en/", "http://b.example.net/e\u0301/", "a://b://net/"]
    labels = [(i, int(i % 3 > 0), 0) for i in range(14)] + [(i * 50, 1, 0) for i in range(1, 20)] + [(None, 1, 0), (3, None, 0), (999, 0, 1)]
    return save(
        spark, tmp_path_factory.mktemp("edge"), documents=table(spark, edge_rows(), DOCUMENTS), labels=table(spark, labels, "doc_id long, quality int, toxic int", False),
        embeddings=table(spark, vectors, "vec_id long, embedding array<double>, label int", False).withColumn("id", F.lit("clash")),
        pages=table(spark, [(i, u, None) for i, u in enumerate(urls)] + [(3, urls[3], "x"), (None, urls[0], None)], "page_id long, url string, html string"),
    )


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return save(
        spark, tmp_path_factory.mktemp("empty"), documents=table(spark, [], DOCUMENTS), labels=table(spark, [], "doc_id long, quality int, toxic int"),
        embeddings=table(spark, [], "vec_id long, embedding array<float>, label int"), pages=table(spark, [], "page_id long, url string, html string"),
    )
