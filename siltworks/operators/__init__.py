"""DataFrame-to-DataFrame operators; none of them reads or writes a layer by itself."""
