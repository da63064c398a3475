"""Errors that users of the package can meet."""


class RasterException(Exception):
    """Anything wrong with layers, sources or legends."""


class RasterAlgebraException(RasterException):
    """A formula cannot be read or evaluated."""


class RasterAggregationException(RasterException):
    """An aggregation is asked for that cannot be done."""
