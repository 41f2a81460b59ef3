"""state is asked with plain rows; a frame for each key cost more than all else."""

from pyspark.sql import Row

from inkwell.streaming.state import FirstSeen


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def update(self, value):
        self.held = value


def test_rows_in_rows_out():
    own = FirstSeen()
    own.first = Value()
    rows = lambda *times: iter([Row(board="b", content_hash="x", us=t) for t in times])
    assert list(own.handleInputRows(("b", "x"), rows(), None)) == []
    assert list(own.handleInputRows(("b", "x"), rows(7, 5, 9), None)) == [Row(board="b", content_hash="x", us=5)]
    assert own.first.held == (5,) and list(own.handleInputRows(("b", "x"), rows(3), None)) == []
