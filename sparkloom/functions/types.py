"""Node types of parsers' raw types, language by language. Each row is a node type and the raw types that have it.

GRAPH_TYPES is the graph layer's table; raw types that it does not have are guessed by keywords there. PARSER_TYPES is the parser layer's, which
has node types of its own and does not guess. Languages that share a table name it.
"""

GRAPH_TYPES = {
    "python": [
        ("FUNCTION", "function_definition async_function_definition"), ("LAMBDA", "lambda"), ("CLASS", "class_definition"), ("BLOCK", "block expression_statement"), ("WITH", "with_statement"),
        ("ASSIGN", "assignment named_expression"), ("AUGMENTED_ASSIGN", "augmented_assignment"), ("IF", "if_statement"), ("LOOP", "for_statement while_statement"), ("TRY", "try_statement"),
        ("CATCH", "except_clause"), ("FINALLY", "finally_clause"), ("RAISE", "raise_statement"), ("ASSERT", "assert_statement"), ("RETURN", "return_statement"), ("BREAK", "break_statement"),
        ("CONTINUE", "continue_statement"), ("YIELD", "yield yield_from"), ("AWAIT", "await"), ("CALL", "call"), ("BINARY_OP", "binary_operator"), ("UNARY_OP", "unary_operator"),
        ("COMPARE", "comparison_operator"), ("BOOL_OP", "boolean_operator"), ("CONDITIONAL", "conditional_expression"), ("INDEX_ACCESS", "subscript"), ("MEMBER_ACCESS", "attribute"),
        ("COMPREHENSION", "list_comprehension set_comprehension dictionary_comprehension generator_expression"), ("IDENTIFIER", "identifier"),
        ("LITERAL", "string integer float true false none concatenated_string"), ("PARAM", "parameter default_parameter typed_parameter"), ("IMPORT", "import_statement import_from_statement"),
        ("SPREAD", "list_splat_pattern dictionary_splat_pattern"), ("PROGRAM", "module"), ("DELETE", "delete_statement"),
    ],
    "javascript": [
        ("FUNCTION", "function_declaration function_expression arrow_function generator_function generator_function_declaration method_definition"), ("CLASS", "class_declaration class_expression"),
        ("BLOCK", "statement_block"), ("WITH", "with_statement"), ("ASSIGN", "assignment_expression variable_declaration lexical_declaration"), ("AUGMENTED_ASSIGN", "augmented_assignment_expression"),
        ("IF", "if_statement"), ("LOOP", "for_statement for_in_statement while_statement do_statement"), ("TRY", "try_statement"), ("CATCH", "catch_clause"), ("FINALLY", "finally_clause"),
        ("RAISE", "throw_statement"), ("RETURN", "return_statement"), ("BREAK", "break_statement"), ("CONTINUE", "continue_statement"), ("YIELD", "yield_expression"), ("AWAIT", "await_expression"),
        ("CALL", "call_expression new_expression"), ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression"), ("CONDITIONAL", "ternary_expression"), ("INDEX_ACCESS", "subscript_expression"),
        ("MEMBER_ACCESS", "member_expression"), ("SPREAD", "spread_element"), ("IDENTIFIER", "identifier"), ("LITERAL", "string template_string number true false null undefined"),
        ("PARAM", "formal_parameters required_parameter optional_parameter"), ("IMPORT", "import_statement import_declaration"), ("MODULE", "export_statement"), ("PROGRAM", "program"),
    ],
    "typescript": "javascript",
    "tsx": "javascript",
    "java": [
        ("FUNCTION", "method_declaration constructor_declaration"), ("LAMBDA", "lambda_expression"), ("CLASS", "class_declaration interface_declaration enum_declaration annotation_type_declaration"),
        ("BLOCK", "block synchronized_statement class_body"), ("ASSIGN", "assignment_expression variable_declarator local_variable_declaration"), ("IF", "if_statement"),
        ("LOOP", "for_statement enhanced_for_statement while_statement do_statement"), ("TRY", "try_statement"), ("CATCH", "catch_clause"), ("FINALLY", "finally_clause"), ("RAISE", "throw_statement"),
        ("RETURN", "return_statement"), ("BREAK", "break_statement"), ("CONTINUE", "continue_statement"), ("ASSERT", "assert_statement"), ("CALL", "method_invocation object_creation_expression"),
        ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression"), ("CONDITIONAL", "ternary_expression"), ("INDEX_ACCESS", "array_access"), ("MEMBER_ACCESS", "field_access"),
        ("IDENTIFIER", "identifier"), ("LITERAL", "string_literal integer_literal floating_point_literal boolean_type null_literal"), ("PARAM", "formal_parameter spread_parameter"),
        ("IMPORT", "import_declaration"), ("MODULE", "package_declaration"), ("PROGRAM", "program"),
    ],
    "rust": [
        ("FUNCTION", "function_item"), ("LAMBDA", "closure_expression"), ("CLASS", "struct_item impl_item trait_item enum_item"), ("BLOCK", "block unsafe_block"), ("ASSIGN", "let_declaration assignment_expression"),
        ("IF", "if_expression if_let_expression match_expression"), ("LOOP", "for_expression while_expression while_let_expression loop_expression"), ("TRY", "try_expression"), ("RETURN", "return_expression"),
        ("BREAK", "break_expression"), ("CONTINUE", "continue_expression"), ("AWAIT", "await_expression"), ("YIELD", "yield_expression"), ("CALL", "call_expression method_call_expression macro_invocation"),
        ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression"), ("INDEX_ACCESS", "index_expression"), ("MEMBER_ACCESS", "field_expression"), ("IDENTIFIER", "identifier"),
        ("LITERAL", "string_literal integer_literal float_literal boolean_literal"), ("PARAM", "parameter self_parameter"), ("IMPORT", "use_declaration"), ("MODULE", "mod_item"), ("PROGRAM", "source_file"),
    ],
    "go": [
        ("FUNCTION", "function_declaration method_declaration"), ("LAMBDA", "func_literal"), ("BLOCK", "block select_statement defer_statement go_statement"),
        ("ASSIGN", "assignment_statement short_var_declaration var_declaration"), ("IF", "if_statement switch_statement type_switch_statement"), ("LOOP", "for_statement range_clause"),
        ("RETURN", "return_statement"), ("BREAK", "break_statement"), ("CONTINUE", "continue_statement"), ("CALL", "call_expression"), ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression"),
        ("INDEX_ACCESS", "index_expression"), ("MEMBER_ACCESS", "selector_expression"), ("IDENTIFIER", "identifier"),
        ("LITERAL", "interpreted_string_literal raw_string_literal int_literal float_literal"), ("PARAM", "parameter_declaration variadic_parameter_declaration"), ("IMPORT", "import_declaration"),
        ("MODULE", "package_clause"), ("PROGRAM", "source_file"),
    ],
    "c": [
        ("FUNCTION", "function_definition"), ("CLASS", "struct_specifier union_specifier enum_specifier"), ("BLOCK", "compound_statement"),
        ("ASSIGN", "assignment_expression init_declarator declaration preproc_def"), ("IF", "if_statement switch_statement"), ("LOOP", "for_statement while_statement do_statement"), ("RETURN", "return_statement"),
        ("BREAK", "break_statement goto_statement"), ("CONTINUE", "continue_statement"), ("CALL", "call_expression"), ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression pointer_expression"),
        ("CONDITIONAL", "conditional_expression"), ("INDEX_ACCESS", "subscript_expression"), ("MEMBER_ACCESS", "field_expression"), ("IDENTIFIER", "identifier"),
        ("LITERAL", "string_literal number_literal true false null"), ("PARAM", "parameter_declaration"), ("IMPORT", "preproc_include"), ("PROGRAM", "translation_unit"),
    ],
    "cpp": [
        ("FUNCTION", "function_definition template_declaration"), ("LAMBDA", "lambda_expression"), ("CLASS", "struct_specifier union_specifier enum_specifier class_specifier"), ("BLOCK", "compound_statement"),
        ("ASSIGN", "assignment_expression init_declarator declaration preproc_def"), ("IF", "if_statement switch_statement"), ("LOOP", "for_statement while_statement do_statement"), ("TRY", "try_statement"),
        ("CATCH", "catch_clause"), ("RAISE", "throw_expression"), ("RETURN", "return_statement"), ("BREAK", "break_statement goto_statement"), ("CONTINUE", "continue_statement"),
        ("CALL", "call_expression new_expression"), ("DELETE", "delete_expression"), ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression pointer_expression"), ("CONDITIONAL", "conditional_expression"),
        ("INDEX_ACCESS", "subscript_expression"), ("MEMBER_ACCESS", "field_expression"), ("IDENTIFIER", "identifier"), ("LITERAL", "string_literal number_literal true false null"),
        ("PARAM", "parameter_declaration"), ("IMPORT", "preproc_include using_declaration"), ("MODULE", "namespace_definition"), ("PROGRAM", "translation_unit"),
    ],
    "terraform": [
        ("PROGRAM", "config_file"), ("BLOCK", "body block object_expression"), ("RESOURCE", "resource_block"), ("DATA_SOURCE", "data_block"), ("VARIABLE", "variable_block"), ("OUTPUT", "output_block"),
        ("PROVIDER", "provider_block"), ("ASSIGN", "locals_block attribute"), ("MODULE", "module_block"), ("SEQUENCE", "tuple_expression"), ("CALL", "function_call"), ("IDENTIFIER", "identifier"),
        ("LITERAL", "string_lit numeric_lit bool_lit null_lit template_expr"), ("CONDITIONAL", "conditional"), ("BINARY_OP", "binary_op"), ("UNARY_OP", "unary_op"), ("INDEX_ACCESS", "index"),
        ("MEMBER_ACCESS", "get_attr"), ("COMPREHENSION", "for_expr"),
    ],
    "yaml": [
        ("PROGRAM", "stream"), ("BLOCK", "document block_sequence_item"), ("MAPPING", "block_mapping flow_mapping"), ("ASSIGN", "block_mapping_pair flow_pair"), ("SEQUENCE", "block_sequence flow_sequence"),
        ("IDENTIFIER", "alias anchor tag"), ("LITERAL", "plain_scalar single_quote_scalar double_quote_scalar block_scalar boolean_scalar null_scalar integer_scalar float_scalar"),
    ],
}

PARSER_TYPES = {
    "python": [
        ("PROGRAM", "module"), ("FUNCTION", "function_definition async_function_definition"), ("CLASS", "class_definition"), ("BLOCK", "block with_statement"), ("EXPRESSION_STATEMENT", "expression_statement"),
        ("ASSIGN", "assignment"), ("AUGMENTED_ASSIGN", "augmented_assignment"), ("RETURN", "return_statement"), ("IMPORT", "import_statement import_from_statement"), ("DELETE", "delete_statement"),
        ("RAISE", "raise_statement"), ("ASSERT", "assert_statement"), ("IF", "if_statement"), ("ELIF", "elif_clause"), ("ELSE", "else_clause"), ("LOOP", "for_statement while_statement"),
        ("BREAK", "break_statement"), ("CONTINUE", "continue_statement"), ("TRY", "try_statement"), ("CATCH", "except_clause"), ("FINALLY", "finally_clause"), ("CALL", "call"),
        ("BINARY_OP", "binary_operator"), ("UNARY_OP", "unary_operator"), ("COMPARISON", "comparison_operator"), ("LOGICAL_OP", "boolean_operator"), ("TERNARY", "conditional_expression"), ("AWAIT", "await"),
        ("YIELD", "yield yield_from"), ("LAMBDA", "lambda"), ("IDENTIFIER", "identifier"), ("LITERAL", "integer float string true false none concatenated_string"), ("ATTRIBUTE", "attribute"),
        ("SUBSCRIPT", "subscript"), ("ARRAY", "list"), ("TUPLE", "tuple"), ("SET", "set"), ("DICT", "dictionary"), ("PAIR", "pair"), ("TYPE_ANNOTATION", "type"),
        ("PARAMETER", "parameters typed_parameter"), ("DEFAULT_VALUE", "default_parameter"), ("ARGUMENT", "argument_list"), ("KEYWORD_ARGUMENT", "keyword_argument"),
        ("DECORATOR", "decorated_definition decorator"), ("COMMENT", "comment"), ("DOCSTRING", "string_content"), ("SPREAD", "starred"),
    ],
    "java": [
        ("PROGRAM", "program"), ("CLASS", "class_declaration"), ("INTERFACE", "interface_declaration"), ("ENUM", "enum_declaration"), ("FUNCTION", "method_declaration constructor_declaration"), ("BLOCK", "block"),
        ("EXPRESSION_STATEMENT", "expression_statement"), ("ASSIGN", "assignment_expression variable_declarator"), ("RETURN", "return_statement"), ("IMPORT", "import_declaration"), ("RAISE", "throw_statement"),
        ("ASSERT", "assert_statement"), ("IF", "if_statement"), ("LOOP", "for_statement enhanced_for_statement while_statement do_statement"), ("BREAK", "break_statement"), ("CONTINUE", "continue_statement"),
        ("SWITCH", "switch_expression"), ("CASE", "switch_label"), ("TRY", "try_statement"), ("CATCH", "catch_clause"), ("FINALLY", "finally_clause"), ("CALL", "method_invocation object_creation_expression"),
        ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression"), ("TERNARY", "ternary_expression"), ("IDENTIFIER", "identifier"),
        ("LITERAL", "decimal_integer_literal decimal_floating_point_literal string_literal true false null_literal"), ("ATTRIBUTE", "field_access"), ("SUBSCRIPT", "array_access"), ("ARRAY", "array_initializer"),
        ("TYPE_ANNOTATION", "type_identifier"), ("GENERIC", "generic_type"), ("PARAMETER", "formal_parameters formal_parameter"), ("ARGUMENT", "argument_list"), ("ANNOTATION", "annotation"),
        ("COMMENT", "line_comment block_comment"),
    ],
    "javascript": [
        ("PROGRAM", "program"), ("FUNCTION", "function_declaration function_expression generator_function"), ("LAMBDA", "arrow_function"), ("CLASS", "class_declaration"), ("BLOCK", "statement_block"),
        ("EXPRESSION_STATEMENT", "expression_statement"), ("ASSIGN", "assignment_expression variable_declarator"), ("RETURN", "return_statement"), ("IMPORT", "import_statement"), ("RAISE", "throw_statement"),
        ("IF", "if_statement"), ("ELSE", "else_clause"), ("LOOP", "for_statement for_in_statement for_of_statement while_statement do_statement"), ("BREAK", "break_statement"), ("CONTINUE", "continue_statement"),
        ("SWITCH", "switch_statement"), ("CASE", "switch_case"), ("TRY", "try_statement"), ("CATCH", "catch_clause"), ("FINALLY", "finally_clause"), ("CALL", "call_expression new_expression"),
        ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression"), ("TERNARY", "ternary_expression"), ("AWAIT", "await_expression"), ("YIELD", "yield_expression"), ("IDENTIFIER", "identifier"),
        ("LITERAL", "number string template_string true false null undefined"), ("ATTRIBUTE", "member_expression"), ("SUBSCRIPT", "subscript_expression"), ("ARRAY", "array"), ("DICT", "object"), ("PAIR", "pair"),
        ("SPREAD", "spread_element"), ("PARAMETER", "formal_parameters"), ("ARGUMENT", "arguments"), ("DECORATOR", "decorator"), ("COMMENT", "comment"),
    ],
    "typescript": "javascript",
    "tsx": "javascript",
    "rust": [
        ("PROGRAM", "source_file"), ("FUNCTION", "function_item"), ("LAMBDA", "closure_expression"), ("CLASS", "struct_item impl_item"), ("INTERFACE", "trait_item"), ("ENUM", "enum_item"), ("MODULE", "mod_item"),
        ("BLOCK", "block unsafe"), ("EXPRESSION_STATEMENT", "expression_statement"), ("ASSIGN", "assignment_expression let_declaration"), ("RETURN", "return_expression"), ("IMPORT", "use_declaration"),
        ("BREAK", "break_expression"), ("CONTINUE", "continue_expression"), ("IF", "if_expression"), ("ELSE", "else_clause"), ("LOOP", "loop_expression for_expression while_expression"),
        ("SWITCH", "match_expression"), ("CASE", "match_arm"), ("CALL", "call_expression method_call_expression macro_invocation"), ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression"),
        ("AWAIT", "await_expression"), ("IDENTIFIER", "identifier"), ("LITERAL", "integer_literal float_literal string_literal boolean_literal char_literal"), ("ATTRIBUTE", "field_expression"),
        ("SUBSCRIPT", "index_expression"), ("ARRAY", "array_expression"), ("TUPLE", "tuple_expression"), ("DICT", "struct_expression"), ("TYPE_ANNOTATION", "type_identifier"), ("GENERIC", "generic_type"),
        ("PARAMETER", "parameters"), ("ARGUMENT", "arguments"), ("ANNOTATION", "attribute_item"), ("COMMENT", "line_comment block_comment"),
    ],
    "go": [
        ("PROGRAM", "source_file"), ("FUNCTION", "function_declaration method_declaration"), ("LAMBDA", "func_literal"), ("CLASS", "type_declaration"), ("INTERFACE", "interface_type"), ("BLOCK", "block"),
        ("EXPRESSION_STATEMENT", "expression_statement go_statement defer_statement"), ("ASSIGN", "assignment_statement short_var_declaration var_declaration"), ("RETURN", "return_statement"),
        ("IMPORT", "import_declaration"), ("IF", "if_statement"), ("LOOP", "for_statement range_clause"), ("BREAK", "break_statement"), ("CONTINUE", "continue_statement"),
        ("SWITCH", "switch_statement type_switch_statement select_statement"), ("CASE", "expression_case"), ("CALL", "call_expression"), ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression"),
        ("IDENTIFIER", "identifier"), ("LITERAL", "int_literal float_literal interpreted_string_literal raw_string_literal true false nil"), ("ATTRIBUTE", "selector_expression"), ("SUBSCRIPT", "index_expression"),
        ("DICT", "composite_literal"), ("ARRAY", "slice_expression"), ("TYPE_ANNOTATION", "type_identifier"), ("PARAMETER", "parameter_declaration"), ("ARGUMENT", "argument_list"), ("COMMENT", "comment"),
    ],
    "terraform": [
        ("PROGRAM", "config_file"), ("BLOCK", "body block"), ("CONFIG_KEY", "attribute"), ("CONFIG_VALUE", "expression"), ("RESOURCE", "resource"), ("PROVIDER", "provider"), ("VARIABLE", "variable"), ("OUTPUT", "output"),
        ("DATA_SOURCE", "data"), ("MODULE_CALL", "module"), ("IDENTIFIER", "identifier"), ("LITERAL", "string_lit numeric_lit bool_lit null_lit template_expr"), ("CALL", "function_call"), ("DICT", "object"),
        ("PAIR", "object_elem"), ("ARRAY", "tuple"), ("LOOP", "for_expr"), ("TERNARY", "conditional"), ("COMMENT", "comment"),
    ],
    "hcl": "terraform",
    "yaml": [
        ("PROGRAM", "stream"), ("MODULE", "document"), ("DICT", "block_mapping flow_mapping"), ("PAIR", "block_mapping_pair flow_pair"), ("ARRAY", "block_sequence block_sequence_item flow_sequence"),
        ("LITERAL", "plain_scalar single_quote_scalar double_quote_scalar block_scalar"), ("IDENTIFIER", "alias anchor"), ("TYPE_ANNOTATION", "tag"), ("COMMENT", "comment"),
    ],
    "c": [
        ("PROGRAM", "translation_unit"), ("FUNCTION", "function_definition"), ("ASSIGN", "declaration preproc_def"), ("BLOCK", "compound_statement"), ("EXPRESSION_STATEMENT", "expression_statement"),
        ("RETURN", "return_statement"), ("IF", "if_statement"), ("ELSE", "else_clause"), ("LOOP", "for_statement while_statement do_statement"), ("BREAK", "break_statement"), ("CONTINUE", "continue_statement"),
        ("SWITCH", "switch_statement"), ("CASE", "case_statement"), ("CALL", "call_expression"), ("BINARY_OP", "binary_expression"), ("UNARY_OP", "unary_expression"), ("TERNARY", "conditional_expression"),
        ("IDENTIFIER", "identifier"), ("LITERAL", "number_literal string_literal true false null"), ("ATTRIBUTE", "field_expression"), ("SUBSCRIPT", "subscript_expression"), ("ARRAY", "initializer_list"),
        ("PARAMETER", "parameter_declaration"), ("ARGUMENT", "argument_list"), ("COMMENT", "comment"), ("IMPORT", "preproc_include"),
    ],
    "cpp": "c",
}


def rows(tables: dict) -> list[tuple[str, str, str]]:
    """(language, raw_type, node_type) of every language."""
    out = []
    for language, table in tables.items():
        for node_type, raw in tables[table] if isinstance(table, str) else table:
            out += [(language, r, node_type) for r in raw.split()]
    return out
