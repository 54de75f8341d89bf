from bazaarflow.llm import worker_memory


def test_an_owner_keeps_its_store_until_another_one_begins():
    own = worker_memory.kept("one")
    own["dictionary"] = {1: 2}
    assert worker_memory.kept("one") is own and own["dictionary"] == {1: 2}
    assert worker_memory.kept("two") == {}
    assert worker_memory.kept("one") == {}
