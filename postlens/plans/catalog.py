"""All registered queries that need no optional part of the package."""

from . import board

QUERIES = dict(board.QUERIES)
ORACLES = dict(board.ORACLES)
