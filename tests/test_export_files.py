import json

import pandas as pd

from checks.export_files import document_lines


def _written(batches):
    rows = [v for frame in document_lines()(iter(batches)) for v in frame["value"]]
    return rows, "".join(r + "\n" for r in rows)


def test_document_holds_no_more_than_a_record_a_row():
    records = [json.dumps({"k": i, "t": '}],[{"x": "\\'}) for i in range(7)]
    rows, text = _written([pd.DataFrame({"value": records[:3]}), pd.DataFrame({"value": []}), pd.DataFrame({"value": records[3:]})])
    # The bytes of the whole document as one row, written by the text writer.
    assert text == "[" + ",\n ".join(records) + "\n]" + "\n"
    assert json.loads(text) == [json.loads(r) for r in records]
    assert max(len(r) for r in rows) <= max(len(r) for r in records) + 2


def test_document_of_an_empty_partition_and_of_one_record():
    assert _written([])[1] == "[\n]\n"
    assert _written([pd.DataFrame({"value": ['{"a":1}']})])[1] == '[{"a":1}\n]\n'


def test_whole_document_files_are_read_by_several_tasks_when_large(spark, sf, monkeypatch):
    """s1_s5_s7_whole_document_files cuts documents above SPLIT_OVER at the array's commas, with the same rows."""
    import __spark_entry__ as entry
    from checks.compare import difference, duck
    from trainlake.sources import documents, readers

    name = "s1_s5_s7_whole_document_files"
    cut = []
    elements = documents.elements
    monkeypatch.setattr(documents, "elements", lambda *a, **k: cut.append(a) or elements(*a, **k))
    monkeypatch.setattr(readers, "SPLIT_OVER", 0)
    result = difference(entry.queries()[name](spark, sf), entry.oracle_sql()[name], duck(sf))
    assert cut, "every document was read whole by one task"
    assert result in (None, "no rows"), result
