"""DataFrame operators of the dictionary: build, lookup, navigation, statistics."""
