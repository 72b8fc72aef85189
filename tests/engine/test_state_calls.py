"""How often a key's items call its state."""

from types import SimpleNamespace

from evidentia.streaming import keyed


class Store:
    """State of one key, with a count of the calls."""

    def __init__(self):
        self.calls, self.value, self.listed, self.mapped, self.timers = 0, None, [], {}, set()

    def __getattr__(self, name):
        does = {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: self.__dict__.update(value=v),
            "containsKey": lambda k: k in self.mapped, "updateValue": self.mapped.__setitem__, "appendList": self.listed.extend, "appendValue": self.listed.append,
            "registerTimer": self.timers.add, "deleteTimer": self.timers.discard,
        }[name]

        def call(*given):
            self.calls += 1
            return does(*given)

        return call


def test_state_is_read_and_written_once_a_batch():
    store, runs = Store(), Store()
    runs.__dict__["get"] = lambda: (store.__dict__.update(calls=store.calls + 1), iter(runs.listed))[1]
    handle = SimpleNamespace(getValueState=lambda *_: store, getListState=lambda *_: runs, getMapState=lambda *_: runs, registerTimer=store.registerTimer, deleteTimer=store.deleteTimer)
    flow = keyed.Snapshots(["k"], 2)
    flow.init(handle)
    hour = 3_600_000_000
    for batch in range(2):
        before = store.calls + runs.calls
        items = [SimpleNamespace(us=(batch * 60 + i) * hour, item=i, run=f"r{(batch * 60 + i) // 4}") for i in range(62)]
        out = list(flow.handleInputRows(("a",), items, None))
        assert len(out) == 62 and sum(r.counted for r in out) == (16 if batch == 0 else 15)
        assert store.calls + runs.calls - before <= 6
