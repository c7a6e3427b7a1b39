"""Device files written here and read back sample for sample, whole and in splits."""

import gzip
import zipfile

import numpy as np
import pytest

from kinelake.sources import devices, readers

BASE = 1_715_000_000_000_000


def samples(n, rate, seed=1, step=1 / 256, most=2.0):
    rng = np.random.default_rng(seed)
    return BASE + np.rint(np.arange(n) * 1e6 / rate).astype(np.int64), np.rint(rng.uniform(-most, most, (n, 3)) / step) * step


def got(df):
    return sorted((r.subject_id, r.us, r.x, r.y, r.z) for r in df.collect())


@pytest.mark.parametrize("wide, most", [(False, 1.9), (True, 7.5)])
def test_blocks_come_back_whole_and_in_splits(spark, tmp_path, wide, most):
    us, xyz = samples(5003, 100.0, most=most)
    raw = devices.blocks_of(us, xyz, 100.0, wide)
    (tmp_path / "p1.cwa").write_bytes(raw)
    (tmp_path / "p2.cwa.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "p3.cwa").write_bytes(devices.blocks_of(us[:1], xyz[:1], 100.0, wide))
    whole = got(devices.read_device(spark, f"{tmp_path}/*.cwa*", "cwa"))
    cut = devices.read_device(spark, f"{tmp_path}/*.cwa*", "cwa", split=3 * 512)
    assert cut.rdd.getNumPartitions() > 10 and got(cut) == whole
    for name, n in (("p1", 5003), ("p2", 5003), ("p3", 1)):
        own = [r for r in whole if r[0] == name]
        assert len(own) == n
        assert np.abs(np.array([r[1] for r in own]) - us[:n]).max() <= 40  # the clock has 15 bits a second
        np.testing.assert_allclose(np.array([r[2:] for r in own]), xyz[:n], atol=(0 if wide else 1 / 256) + 1e-6)


def test_unsound_blocks_gaps_and_other_files(spark, tmp_path):
    us, xyz = samples(360, 100.0)
    first, late = devices.blocks_of(us, xyz, 100.0), devices.blocks_of(us + 3_600_000_000, xyz, 100.0)
    bad = bytearray(first)
    bad[1024 + 512 + 100] ^= 1  # the second block fails its checksum
    (tmp_path / "a.cwa").write_bytes(bytes(bad) + late[1024:] + b"AX cut short")
    rows = got(devices.read_device(spark, f"{tmp_path}/a.cwa", "cwa"))
    times = [r[1] for r in rows]
    assert len(rows) == 240 + 360 and max(np.diff(times)) > 3_000_000_000 and np.diff(times)[:119].max() <= 10_100
    (tmp_path / "b.cwa").write_bytes(b"not one")
    with pytest.raises(Exception, match="not a block file"):
        devices.read_device(spark, f"{tmp_path}/b.cwa", "cwa").count()
    (tmp_path / "c.cwa").write_bytes(b"")
    assert devices.read_device(spark, f"{tmp_path}/c.cwa", "cwa").count() == 0


def pages(us, raw, rate, gain, offset):
    text = "Device Identity\nCalibration Data\n" + "".join(f"{c} gain:{gain[k]}\n{c} offset:{offset[k]}\n" for k, c in enumerate("xyz"))
    for n, lo in enumerate(range(0, len(us), 300)):
        time = np.datetime64(int(us[lo]), "us").astype("datetime64[ms]").item().strftime("%Y-%m-%d %H:%M:%S:%f")[:-3]
        hexa = "".join(f"{x & 0xFFF:03X}{y & 0xFFF:03X}{z & 0xFFF:03X}000" for x, y, z in raw[lo : lo + 300].tolist())
        text += f"Recorded Data\nDevice Unique Serial Code:1\nSequence Number:{n}\nPage Time:{time}\nUnassigned:\nTemperature:21.{n}\nBattery voltage:4.1\nDevice Status:Recording\nMeasurement Frequency:{rate}\n{hexa}\n"
    return text.encode()


def test_pages_come_back_whole_and_in_splits(spark, tmp_path):
    rng = np.random.default_rng(5)
    us, raw, gain, offset = BASE + np.arange(3050, dtype=np.int64) * 20_000, rng.integers(-2048, 2048, (3050, 3)), (25_000, 25_100, 25_200), (-300, 20, 400)
    (tmp_path / "g.bin").write_bytes(pages(us, raw, 50.0, gain, offset))
    whole = got(devices.read_device(spark, f"{tmp_path}/g.bin", "bin"))
    assert got(devices.read_device(spark, f"{tmp_path}/g.bin", "bin", split=2048)) == whole
    assert [r[1] for r in whole] == us.tolist()
    np.testing.assert_allclose(np.array([r[2:] for r in whole]), (raw * 100.0 - offset) / gain, rtol=1e-5, atol=1e-6)


def test_archives_of_both_kinds(spark, tmp_path):
    rng = np.random.default_rng(6)
    raw = rng.integers(-2048, 2048, (6, 30, 3))
    log = b""
    for k, second in enumerate(raw):
        if k == 3:
            log += bytes([0x1E, 6]) + (1).to_bytes(4, "little") + (2).to_bytes(2, "little") + b"xx\0"  # another kind of record
        if k % 2:
            body = second.astype("<i2").tobytes()
        else:
            flat = (second[:, [1, 0, 2]].ravel() & 0xFFF).reshape(-1, 2)
            body = np.stack([flat[:, 0] >> 4, (flat[:, 0] & 0xF) << 4 | flat[:, 1] >> 8, flat[:, 1] & 0xFF], 1).astype(np.uint8).tobytes()
        log += bytes([0x1E, 26 if k % 2 else 0]) + (BASE // 1_000_000 + k).to_bytes(4, "little") + len(body).to_bytes(2, "little") + body + b"\0"
    with zipfile.ZipFile(tmp_path / "z.gt3x", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("info.txt", "Serial Number: X\nAcceleration Scale: 256.0\nSample Rate: 30\n")
        z.writestr("log.bin", log)
    rows = got(devices.read_device(spark, f"{tmp_path}/z.gt3x", "gt3x"))
    assert len(rows) == 180 and rows[30][1] - rows[0][1] == 1_000_000
    np.testing.assert_allclose(np.array([r[2:] for r in rows]), raw.reshape(-1, 3) / 256, atol=1e-6)


def test_recordings_are_told_by_their_extension(spark, tmp_path):
    us, xyz = samples(240, 100.0)
    (tmp_path / "q.cwa").write_bytes(devices.blocks_of(us, xyz, 100.0))
    assert readers.read_recording(spark, f"{tmp_path}/q.cwa").columns == ["subject_id", "us", "x", "y", "z"]
    assert readers.read_recording(spark, f"{tmp_path}/q.cwa").count() == 240
