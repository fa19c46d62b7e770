import os
import shutil

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def sf_with(tmp_path):
    """A copy of the small tables in which some tables are replaced by given DataFrames."""
    def make(**tables):
        for name in os.listdir(SF):
            if name.removesuffix(".parquet") not in tables:
                os.symlink(f"{SF}/{name}", tmp_path / name)
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return make
