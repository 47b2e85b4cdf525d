"""Planning: command-line style options, layouts and split ranges."""
