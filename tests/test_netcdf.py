"""The classic NetCDF scan: files written here come back as rows, whole or within bounds."""

import io
import tempfile
import zipfile
from datetime import date, datetime
from pathlib import Path

import numpy as np
import pytest
from tidecube.sources import netcdf

LAT, LON = np.array([10.0, 10.5, 11.0]), np.array([-3.0, -2.0, -1.0, 0.0])


def raster(version=2, records=True, days=4, start="1995-01-01 06:00:00", names=("lat", "lon", "time"), turned=False, packed=False, extra=False):
    """A file of two variables; also the doubles that it holds, NaN where nothing is."""
    lat, lon, time = names
    rng = np.random.default_rng(days)
    a, b = rng.normal(size=(2, days, 3, 4))
    a[0, 0, 0] = b[0, 0, 0] = a[1, 2, 3] = np.nan
    attributes = {"_FillValue": np.float64(-999.0)}
    stored = np.where(np.isnan(a), -999.0, a)
    if packed:
        stored = np.where(np.isnan(a), -32768, np.round(a / 0.01)).astype("i2")
        a = np.where(stored == -32768, np.nan, stored * 0.01 + 5)
        attributes = {"_FillValue": np.int16(-32768), "scale_factor": np.float64(0.01), "add_offset": np.float64(5)}
    b = b.astype("f4")
    on = (time, lon, lat) if turned else (time, lat, lon)
    side = (0, 2, 1) if turned else (0, 1, 2)
    first, second = stored.transpose(side), b.transpose(side)
    dims = {time: None if records else days, lat: 3, lon: 4}
    if extra:
        on, first, second, dims = (on[0], "zlev", *on[1:]), first[:, None], second[:, None], dims | {"zlev": 1}
    data = netcdf.encode(
        dims,
        {
            lat: ((lat,), LAT, {"units": "degrees_north"}), lon: ((lon,), LON, {}), time: ((time,), np.arange(days, dtype="f8") * 24, {"units": f"hours since {start}"}),
            "sst": (on, first, attributes), "u10": (on, second, {}),
        },
        version,
    )
    return data, a, b.astype("f8")


def write(files):
    folder = Path(tempfile.mkdtemp(prefix="spark-nc-"))
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select("date", "lat_idx", "lon_idx", *columns).collect())


def same(got, wanted):
    assert [r[:3] for r in got] == [r[:3] for r in wanted]
    assert [r[3] for r in got] == pytest.approx([float(r[3]) for r in wanted])


def expected(a, first=date(1995, 1, 1)):
    return sorted((date.fromordinal(first.toordinal() + t), i, j, a[t, i, j]) for t, i, j in np.ndindex(a.shape) if not np.isnan(a[t, i, j]))


@pytest.mark.parametrize("options", [
    {"version": 1}, {"version": 2, "records": False}, {"version": 5, "packed": True}, {"names": ("latitude", "longitude", "valid_time")}, {"turned": True}, {"extra": True}, {"packed": True, "records": False},
])
def test_a_written_file_comes_back(spark, options):
    data, a, b = raster(**options)
    folder = write({"x.nc": data})
    got = netcdf.scan(spark, folder, ["sst"])
    same(rows(got, "sst"), expected(a))
    r = got.orderBy("time", "pixel").first()
    assert (r.time, r.date, r.member, r.pixel, r.lat, r.lon) == (datetime(1995, 1, 1, 6), date(1995, 1, 1), None, 1, 10.0, -2.0)
    same(rows(netcdf.scan(spark, folder, ["10m_u_component_of_wind"]), "10m_u_component_of_wind"), expected(b))
    both = netcdf.scan(spark, folder, ["sst", "u10"])
    assert both.count() == (~(np.isnan(a) & np.isnan(b))).sum() and both.where("sst IS NULL").count() == (np.isnan(a) & ~np.isnan(b)).sum()


def test_shares_of_a_file_zips_and_folders(spark):
    one, a, _ = raster(days=9)
    two, b, _ = raster(days=2, start="2001-02-03")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/two.nc", two)
        z.writestr("readme.txt", "no raster")
    folder = write({"one.nc": one, "two.zip": packed.getvalue(), "other.txt": b"no raster"})
    whole = sorted(expected(a) + expected(b, date(2001, 2, 3)))
    for size in (1 << 27, 200):
        df = netcdf.scan(spark, folder, ["sst"], bytes_a_task=size)
        same(rows(df, "sst"), whole)
        assert (df.rdd.getNumPartitions() > 5) == (size == 200)
    assert {r.member for r in netcdf.scan(spark, f"{folder}/two.zip", ["sst"]).collect()} == {"in/two.nc"}
    same(rows(netcdf.scan(spark, [f"file://{folder}/one.nc"], ["sst"]), "sst"), expected(a))
    assert netcdf.scan(spark, write({}), ["sst"]).count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_bounds_give_the_rows_that_a_filter_gives(spark, turned):
    data, a, _ = raster(days=6, turned=turned)
    folder = write({"x.nc": data})
    whole, inside = netcdf.scan(spark, folder, ["sst"]), netcdf.scan(spark, folder, ["sst"], box=(-1, 11, -2, 10.5), days=("1995-01-03", date(1995, 1, 4)))
    wanted = [r for r in expected(a) if 3 <= r[0].day < 5 and r[1] >= 1 and r[2] in (1, 2)]
    same(rows(inside, "sst"), wanted)
    same(rows(whole.where("date BETWEEN '1995-01-03' AND '1995-01-04' AND lat >= 10.5 AND lon IN (-2, -1)"), "sst"), wanted)
    assert whole.count() == len(expected(a)) and whole.join(inside, "pixel").count() == sum(x[1:3] == y[1:3] for x in expected(a) for y in wanted)
    assert netcdf.scan(spark, folder, ["sst"], box=(50, 50, 60, 60)).count() == netcdf.scan(spark, folder, ["sst"], days=("1990-01-01", "1990-01-02")).count() == 0


def test_rasters_without_a_time(spark):
    data = netcdf.encode({"lat": 3, "lon": 4}, {"lat": (("lat",), LAT, {}), "lon": (("lon",), LON, {}), "depth": (("lat", "lon"), np.arange(12, dtype="i4").reshape(3, 4), {"missing_value": np.int32(5)})})
    folder = write({"x.nc": data})
    got = netcdf.scan(spark, folder, ["depth"]).orderBy("pixel").collect()
    assert [(r.date, r.pixel, r.depth) for r in got] == [(None, i, float(i)) for i in range(12) if i != 5]
    assert netcdf.scan(spark, folder, ["depth"], days=("1900-01-01", "2100-01-01")).count() == 0


class Counted(io.BytesIO):
    count = 0

    def read(self, n=-1):
        out = super().read(n)
        self.count += len(out)
        return out


def test_only_wanted_slabs_are_read():
    n = 400
    v = np.arange(5.0 * n * n).reshape(5, n, n)
    data = netcdf.encode({"time": 5, "lat": n, "lon": n}, {"lat": (("lat",), np.arange(float(n)), {}), "lon": (("lon",), np.arange(float(n)), {}), "time": (("time",), np.arange(5.0), {"units": "days since 1970-01-01"}), "v": (("time", "lat", "lon"), v, {})})
    f = Counted(data)
    got = [b for b in netcdf.Slabs(f, len(data), ["v"], {"lat": (10, 19), "lon": (3, 4), "date": (2, 2)}).batches(0, 1)]
    assert np.concatenate([b["v"] for b in got]).tolist() == v[2, 10:20, 3:5].ravel().tolist()
    assert f.count < 10 * n * 8 + 3 * n * 8 + (1 << 16)


def test_streamed_records_and_a_single_unpadded_variable():
    data = bytearray(netcdf.encode({"time": None, "lat": 1, "lon": 3}, {"lat": (("lat",), [1.0], {}), "lon": (("lon",), [1.0, 2.0, 3.0], {}), "v": (("time", "lat", "lon"), np.arange(15, dtype="i2").reshape(5, 1, 3), {})}, 1))
    data[4:8] = b"\xff" * 4
    head = netcdf.header(io.BytesIO(data), len(data))
    assert head.variables["v"].shape == (5, 1, 3)
    assert netcdf.values(io.BytesIO(data), head, head.variables["v"], 4, 8).tolist() == list(range(4, 12))


def test_what_cannot_be_read_says_so():
    def slabs(data, wanted=("sst",)):
        return netcdf.Slabs(io.BytesIO(data), len(data), list(wanted), {})

    good = raster()[0]
    for data, wanted, message in [
        (b"\x89HDF\r\n\x1a\n" + b"\0" * 50, ["sst"], "NetCDF 4"), (b"no file at all", ["sst"], "not a classic"), (good[:40], ["sst"], "too early"), (good, ["chl"], "no variable chl"),
        (raster(start="0001-01-01")[0], ["sst"], "calendars"), (raster(names=("y", "x", "time"))[0], ["sst"], "no latitude"), (good, ["sst", "lat"], "different dimensions"),
    ]:
        with pytest.raises(ValueError, match=message):
            slabs(data, wanted)
    with pytest.raises(ValueError, match="ends too early"):
        list(slabs(good[:-20], ["u10"]).batches(0, 1))


def test_units_of_times():
    for units, x, seconds in [("days since 1970-01-02", 0.5, 129600), ("seconds since 1970-01-01T00:00:00Z", 7, 7), ("hours since 1900-01-01 00:00:00.0", 613608, 0), ("minutes since 1970-1-1 0:0:30", 1, 90)]:
        assert netcdf.micros(np.array([x], "f8"), {"units": units})[0] == seconds * 1_000_000
    with pytest.raises(ValueError, match="can't be read"):
        netcdf.micros(np.array([1.0]), {"units": "days since 1970-01-01", "calendar": "noleap"})
