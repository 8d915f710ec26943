"""A Python data source for NetCDF grids; needs the netCDF4 library, which is imported when it reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Time steps of a partition; a file is opened once for each.
STEPS = 8


def _names(options: dict) -> list[str]:
    """Variables to read: `variables` (commas between) or `variable`, without those in `dropVariables`."""
    wanted = options.get("variables") or options.get("variable")
    if not wanted:
        raise ValueError("the option variables (or variable) is missing")
    dropped = {x.strip() for x in options.get("dropvariables", "").split(",")}
    return [x.strip() for x in wanted.split(",") if x.strip() not in dropped]


class NetcdfSource(DataSource):
    """options: path (a file, several with commas between, or a template with {date}, startYear and endYear, the end left
    out; such a file holds times of its year alone), stepsPerPartition, variables (one gives the column `value`, several columns of their own names), dropVariables,
    time, lat, lon (names of the dimensions), decodeTimes (false: raw numbers).

    A time step's grid goes to Spark as one Arrow batch, so no cell is a Python object. NaN and fill
    values become null. Cells are numbered by row and column.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        options = {k.lower(): v for k, v in self.options.items()}
        names = _names(options)
        values = "value double" if len(names) == 1 else ", ".join(f"`{n}` double" for n in names)
        return f"time {'timestamp_ntz' if _decoded(options) else 'double'}, cell_id long, i_lat int, i_lon int, lat double, lon double, {values}"

    def reader(self, schema) -> DataSourceReader:
        return NetcdfReader({k.lower(): v for k, v in self.options.items()})


def _as(value, like):
    """A condition's value in the form of a time; None where the two cannot be compared."""
    if isinstance(like, dt.datetime):
        if isinstance(value, dt.datetime):
            return value.replace(tzinfo=None) if value.tzinfo is None else None
        return dt.datetime(value.year, value.month, value.day) if isinstance(value, dt.date) else None
    return float(value) if isinstance(value, (int, float)) else None


def _decoded(options: dict) -> bool:
    return options.get("decodetimes", "true").lower() == "true"


class Steps(InputPartition):
    """Time steps start..stop of one file."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class NetcdfReader(DataSourceReader):
    """Plans partitions from time axes alone: grids are read by tasks.

    Conditions on time are pushed down (spark.sql.python.filterPushdown.enabled): files of years that they rule out are
    never opened, and of the others only the steps that are left are read. Spark applies the conditions again.
    """

    def __init__(self, options: dict):
        self.options = options
        self.bounds: list[Filter] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("time",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, (dt.datetime, dt.date, float, int)):
                self.bounds.append(f)
            yield f

    def _open(self, path: str):
        import netCDF4

        return netCDF4.Dataset(path)

    def _within(self, first, last) -> bool:
        """Whether times from first to last can meet the conditions."""
        for f in self.bounds:
            value = _as(f.value, first)
            if value is None:
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and (last < value or (isinstance(f, GreaterThan) and last == value)):
                return False
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and (first > value or (isinstance(f, LessThan) and first == value)):
                return False
        return True

    def files(self) -> list[tuple[str, int | None]]:
        """(path, year) of every file: `path`, several with commas between, or a template with {date} from startYear to endYear (left out)."""
        path = self.options["path"]
        if "{date}" in path:
            return [(path.format(date=y), y) for y in range(int(self.options["startyear"]), int(self.options["endyear"]))]
        return [(p.strip(), None) for p in path.split(",")]

    def _times(self, axis):
        if not _decoded(self.options):
            return [float(x) for x in axis[:]]
        import netCDF4

        return [netCDF4.num2date(x, axis.units, only_use_cftime_datetimes=False) for x in axis[:]]

    def partitions(self):
        """Runs of stepsPerPartition steps that the conditions leave; times that two files share raise, as when files are combined by coordinates."""
        size, planned, spans = int(self.options.get("stepsperpartition", STEPS)), [], []
        for path, year in self.files():
            if year is not None and not self._within(dt.datetime(year, 1, 1), dt.datetime(year, 12, 31, 23, 59, 59, 999999)):
                continue
            with self._open(path) as data:
                times = self._times(data[self.options.get("time", "time")])
            if not times:
                continue
            if year is not None and any(t.year != year for t in times):
                raise ValueError(f"{path} holds times beyond {year}")
            spans.append((min(times), max(times), set(times), path))
            wanted = [k for k, t in enumerate(times) if self._within(t, t)]
            begin = 0
            for i in range(1, len(wanted) + 1):
                if i == len(wanted) or wanted[i] != wanted[i - 1] + 1 or i - begin == size:
                    planned.append(Steps(path, wanted[begin], wanted[i - 1] + 1))
                    begin = i
        spans.sort(key=lambda s: s[:2])
        latest = None
        for span in spans:
            if latest is not None and span[0] <= latest[1] and span[2] & latest[2]:
                raise ValueError(f"{latest[3]} and {span[3]} share times")
            latest = span if latest is None or span[1] > latest[1] else latest
        return planned

    def read(self, partition):
        with self._open(partition.path) as data:
            for step in range(partition.start, partition.stop):
                yield self._grid(data, step)

    def _grid(self, data, step: int):
        import numpy as np
        import pyarrow as pa

        names, axis = _names(self.options), data[self.options.get("time", "time")]
        raw = axis[step]
        if _decoded(self.options):
            import netCDF4

            when = pa.scalar(netCDF4.num2date(raw, axis.units, only_use_cftime_datetimes=False), pa.timestamp("us"))
        else:
            when = pa.scalar(float(raw), pa.float64())
        lat, lon = (np.asarray(data[self.options.get(n, n)][:], dtype=float) for n in ("lat", "lon"))
        grids = [np.ma.filled(np.ma.asarray(data[n][step]).astype(float), np.nan).ravel() for n in names]
        cells = np.arange(len(lat) * len(lon))
        at = np.divmod(cells, max(len(lon), 1))
        columns = [pa.repeat(when, len(cells)), pa.array(cells), pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(lat[at[0]]), pa.array(lon[at[1]])]
        columns += [pa.array(g, mask=np.isnan(g)) for g in grids]
        return pa.RecordBatch.from_arrays(columns, names=["time", "cell_id", "i_lat", "i_lon", "lat", "lon", *(["value"] if len(names) == 1 else names)])
