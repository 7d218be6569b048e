import pytest

from scriptorium.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    out = session("local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=str(shared), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    out.sparkContext.setLogLevel("ERROR")
    return out
