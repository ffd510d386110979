"""Column expressions and numpy kernels: points, polygons, example fields, quadrature."""
