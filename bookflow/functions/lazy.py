"""Named column expressions that are built when used, so importing needs no Spark session."""


class Columns:
    def __init__(self, **makers):
        self._makers = makers

    def __getattr__(self, name):
        try:
            return self._makers[name]()
        except KeyError:
            raise AttributeError(name) from None
