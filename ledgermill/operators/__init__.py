"""DataFrame operators that the layer plans are put together from."""
