"""Plan helpers: materialisation, size-checked broadcasts, named queries."""
