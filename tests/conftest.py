import pytest

from gristmill.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def base(spark):
    rows = [
        (1, "Alice", 25.0, 10.0, "NYC", 1.0, 2.0, 3.0),
        (2, "Bob", 30.0, 20.0, "LA", 2.0, 4.0, 6.0),
        (3, "Charlie", 35.0, 30.0, "NYC", 3.0, 6.0, 9.0),
        (4, "Dave", None, 40.0, "Chicago", 4.0, 8.0, 12.0),
        (5, "Eve", 45.0, 50.0, "LA", 5.0, 10.0, 15.0),
        (6, None, 50.0, 60.0, "NYC", 6.0, 12.0, 18.0),
    ]
    schema = "id long, name string, age double, score double, city string, a double, b double, c double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def people(spark):
    rows = [
        (25.0, 50000.0, "A", 1.1),
        (30.0, 60000.0, "B", 2.2),
        (35.0, 70000.0, "A", None),
        (40.0, 80000.0, "C", 4.4),
        (45.0, 90000.0, "B", 5.5),
        (200.0, 100000.0, "A", 6.6),
    ]
    return spark.createDataFrame(rows, "age double, salary double, city string, score double")
