"""NetCDF weight files against a parser of the tests' own."""

import struct

import numpy as np
import pytest
from meshweave.operators import build_regridder
from meshweave.sources import healpix_grid, latlon_grid, regular_grid
from meshweave.sources.netcdf import header, load_netcdf_weights, read_header, save_netcdf_weights


def parsed(data):
    """Dimensions, attributes and values of a CDF-2 file, by the format's grammar."""
    at = 4

    def take(kind):
        nonlocal at
        at += struct.calcsize(kind)
        return struct.unpack_from(kind, data, at - struct.calcsize(kind))[0]

    def name():
        nonlocal at
        n = take(">I")
        at += n + -n % 4
        return data[at - n - -n % 4 : at - -n % 4].decode()

    assert data[:4] == b"CDF\x02" and take(">I") == 0
    assert take(">I") == 10
    dims = [(name(), take(">I")) for _ in range(take(">I"))]
    assert take(">I") == 12
    attrs = {}
    for _ in range(take(">I")):
        key = name()
        assert take(">I") == 2
        attrs[key] = name()
    assert take(">I") == 11
    values, end = {}, 0
    for _ in range(take(">I")):
        key = name()
        assert take(">I") == 1
        n = dims[take(">I")][1]
        assert take(">I") == take(">I") == 0
        dtype = {4: ">i4", 6: ">f8"}[take(">I")]
        size, begin = take(">I"), take(">Q")
        assert size == n * np.dtype(dtype).itemsize + -(n * np.dtype(dtype).itemsize) % 4 and begin % 4 == 0 and begin >= end
        end = begin + size
        values[key] = np.frombuffer(data, dtype, n, begin)
    assert end == len(data)
    return dict(dims), attrs, values


@pytest.mark.parametrize("kind", ["plane", "sphere"])
def test_file_has_the_regridder(spark, tmp_path, kind):
    if kind == "plane":
        r = build_regridder(regular_grid(spark, [0, 1.5, 4, 9], [0, 2, 3]), regular_grid(spark, [0, 1, 2, 3, 4, 5], [-1, 0, 1, 2.5])).persist()
    else:
        r = build_regridder(healpix_grid(spark, 2, radius=2.0), latlon_grid(spark, 9, 5, radius=2.0)).persist()
    path = save_netcdf_weights(str(tmp_path / "new" / "w.nc"), r, src_grid_name="fine", src_shape=(5, 3))
    dims, attrs, values = parsed(open(path, "rb").read())
    weights = sorted((w.dst, w.src, w.area) for w in r.weights.collect())
    area_b = {c.cell_id: c.area for c in r.dst_areas.collect()}
    assert dims == {"n_s": len(weights), "n_a": r.n_src, "n_b": r.n_dst}
    assert attrs["normalization"] == "destarea" and attrs["domain_a"] == "fine" and attrs["shape_a"] == "5,3" and "domain_b" not in attrs
    assert values["row"].tolist() == [w[0] for w in weights] and values["col"].tolist() == [w[1] for w in weights]
    assert values["S"] == pytest.approx([w[2] / area_b[w[0]] for w in weights], rel=1e-14)
    dst, src = r.marginals()
    for k, table in (("a", src), ("b", dst)):
        rows = sorted((c.cell_id, c.area, c.frac) for c in table.collect())
        assert values[f"area_{k}"].tolist() == [c[1] for c in rows] and values[f"frac_{k}"] == pytest.approx([c[2] for c in rows])
    back = load_netcdf_weights(spark, path)
    assert back.shape == r.shape and back.manifold == r.manifold
    assert sorted((w.dst, w.src, w.area) for w in back.weights.collect()) == [pytest.approx(w, rel=1e-13) for w in weights]
    assert not (tmp_path / "new" / "w.nc.unfinished").exists()
    r.unpersist()


def test_no_overlap_and_overwriting(spark, tmp_path):
    path = str(tmp_path / "w.nc")
    save_netcdf_weights(path, build_regridder(regular_grid(spark, [0, 1, 2], [0, 1]), regular_grid(spark, [0, 2], [0, 1])))
    save_netcdf_weights(path, build_regridder(regular_grid(spark, [0, 1, 2], [0, 1]), regular_grid(spark, [5, 6], [5, 6])))
    dims, _, values = parsed(open(path, "rb").read())
    assert dims == {"n_s": 0, "n_a": 1, "n_b": 2} and values["frac_b"].tolist() == [0, 0]
    assert load_netcdf_weights(spark, path).weights.isEmpty()


def test_wide_headers(tmp_path):
    front, layout, size = header({"n_s": 2**33, "n_a": 3, "n_b": 2**31}, {"a": "bc", "é": ""})
    (tmp_path / "x.nc").write_bytes(front)
    assert front[3] == 5 and read_header(str(tmp_path / "x.nc")) == layout
    assert size == layout.variables["frac_b"][0] + 8 * 2**31 and layout.variables["row"][1] == ">i8"


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(ValueError, match="no classic"):
        read_header(str(tmp_path / "x.nc"))
