import pytest
from sheafline.sources import shared


class Session:
    """A session that names no shared folder."""

    def __init__(self, master: str) -> None:
        self.conf, self.sparkContext, self.master, self.applicationId = self, self, master, "app"

    def getConf(self):
        return self

    def get(self, name, default=None):
        return default


def test_a_cluster_has_to_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session("spark://host:7077"))
    here = Session("local[2]")
    assert shared.shared_dir(here) == shared.shared_dir(here)
    assert shared.new_path(here, "x") != shared.new_path(here, "x")
