"""Column functions; all stay inside whole-stage code generation unless a docstring says otherwise."""
