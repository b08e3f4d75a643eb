"""DataFrame -> DataFrame operators. Keys such as ``framework`` are always carried."""
