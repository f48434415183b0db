import pyarrow as pa

from docquarry.functions import analysis, batches, outline


def test_slices_bound_the_text_seen_at_once(monkeypatch):
    monkeypatch.setattr(batches, "SLICE_BYTES", 40)
    texts = pa.array(["one two two", None, "", "three " * 30, *["four words and more"] * 9])
    seen = []
    for module, name, run in ((analysis, "count_terms", analysis._plain_counts), (outline, "outline", outline._outline_optional)):
        whole = getattr(module, name)

        def watched(part, *rest, whole=whole):
            seen.append(part)
            return whole(part, *rest)

        want = run(texts).to_pylist()
        monkeypatch.setattr(batches, "SLICE_BYTES", 1 << 20)
        assert run(texts).to_pylist() == want and len(want) == len(texts)
        monkeypatch.setattr(batches, "SLICE_BYTES", 40)
        monkeypatch.setattr(module, name, watched)
        assert run(texts).to_pylist() == want
    parts = [x for x in seen if isinstance(x, pa.Array)]
    assert len(parts) > 4 and all(len(x) == 1 or sum(len(t.as_py() or "") for t in x) <= 80 for x in parts)
    assert batches.in_slices(texts.slice(0, 0), analysis._plain_counts).to_pylist() == []
