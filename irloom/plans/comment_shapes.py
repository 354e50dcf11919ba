"""Shapes of comments and the fields that they have; %w stands for a word. Empty fields are left out."""

from __future__ import annotations


def _param(name: str, description: str = "", direction: str = "") -> dict:
    return {"name": name, "description": description, "direction": direction}


SHAPES: list[tuple[str, dict]] = [
    ("/// The %w in short.", {"brief": "The %w in short."}),
    ("/**\n * @brief Turns the %w.\n *\n * More about it,\n * on two lines.\n */", {"brief": "Turns the %w.", "detail": ["More about it, on two lines."]}),
    ("/** Turns it.\n *\n * And more. */", {"brief": "Turns it.", "detail": ["And more."]}),
    ("//! @param a the %w\n//! @param[out] b the result\n//! @param[inout] c both\n//! @param[sideways] d", {"param": [_param("a", "the %w"), _param("b", "the result", "out"), _param("c", "both", "in,out")], "custom": {"param[sideways]": ["d"]}}),
    ("/// @tparam T its kind\n/// @returns one %w\n/// @result or two\n/// @retval 0 on success\n/// @retval -1", {"tparam": [_param("T", "its kind")], "returns": "one %w or two", "retval": [{"value": "0", "description": "on success"}, {"value": "-1", "description": ""}]}),
    ("/*! @throws std::bad_alloc with no room\n @exception E */", {"throws": [{"exception": "std::bad_alloc", "description": "with no room"}, {"exception": "E", "description": ""}]}),
    ("/// @note first\n/// @remark second\n/// @attention third\n/// @warning fourth", {"note": ["first", "second"], "warning": ["third", "fourth"]}),
    ("/// @pre %w\n/// @post y\n/// @invariant z\n/// @todo do\n/// @bug no\n/// @author A\n/// @authors B, C\n/// @version 3\n/// @date today\n/// @since 1.0\n/// @deprecated use %w", {"pre": ["%w"], "post": ["y"], "invariant": ["z"], "todo": ["do"], "bug": ["no"], "author": ["A", "B, C"], "version": ["3"], "date": ["today"], "since": ["1.0"], "deprecated": ["use %w"]}),
    ("/// @brief One.\n/// @brief Two.", {"brief": "One. Two."}),
    ("/// @house the %w\n/// @house again", {"custom": {"house": ["the %w", "again"]}}),
    ("/// @param a the %w\n///\n/// About the whole.", {"brief": "About the whole.", "param": [_param("a", "the %w")]}),
    ("/// @param a the %w\n///   that goes on\n///     and on", {"param": [_param("a", "the %w that goes on and on")]}),
    ("/// @code\n/// f(%w);\n///   g();\n/// @endcode\n/// Then this.", {"brief": "Then this.", "detail": ["```cpp\nf(%w);\n  g();\n```"]}),
    ("/// Before.\n/// @code{.py}\n/// x = `%w`\n/// y = ```z```\n/// @endcode", {"brief": "Before.", "detail": ["````py\nx = `%w`\ny = ```z```\n````"]}),
    ("/// @verbatim\n/// @param not a command\n/// @endverbatim", {"detail": ["```\n@param not a command\n```"]}),
    ("/// @li one %w\n/// @li two\n/// goes on\n///\n/// Last words.", {"brief": "Last words.", "detail": ["- one %w\n- two goes on"]}),
    ("/// @ingroup A B\n/// What it does.", {"brief": "What it does.", "custom": {"ingroup": ["A B"]}}),
    ("/**\n * @defgroup gid The %w group\n * All about it.\n */", {"brief": "All about it.", "custom": {"defgroup": ["gid The %w group"]}}),
    ("/// @class Box box.hpp\n/// Holds a %w.", {"brief": "box.hpp", "detail": ["Holds a %w."], "custom": {"class": ["Box"]}}),
    ("/** @copydoc Store<std::function<int(%w)>>::put(int) const */", {"see": ["Store::put"]}),
    ("/// @copybrief ::Top<A<B>, 2>::at\n/// @see other, and more", {"see": ["Top::at", "other, and more"]}),
    ("/// See @ref %w::run \"how\" and @c x, or @b not.", {"brief": "See {cpp:any}`how <%w::run>` and `x`, or **not**."}),
    ("/// See @ref some-page and @ref Grid::operator+=.", {"brief": "See `some-page` and {cpp:any}`Grid::operator+=`."}),
    ("/// Write to me@%w.org \\n or @e call.", {"brief": "Write to me@%w.org or *call*."}),
    ("/**\n * Points:\n *\n * * one\n * * two\n */", {"brief": "Points:", "detail": ["* one * two"]}),
    ("/// Points:\n///\n/// * one\n/// * **two**", {"brief": "Points:", "detail": ["* one * **two**"]}),
    ("/*\n plain %w\n*/", {"brief": "plain %w"}),
    ("int x; ///< the %w", {"brief": "int x; ///< the %w"}),
    ("///< behind the %w", {"brief": "behind the %w"}),
    ("/**< behind\n *   it */", {"brief": "behind it"}),
    ("/// <b>Bold</b> &amp; <em>%w</em>", {"brief": "<b>Bold</b> &amp; <em>%w</em>"}),
    ("/// @internal\n/// Hidden %w.\n/// @endinternal", {"brief": "Hidden %w.", "custom": {"internal": [""], "endinternal": [""]}}),
    ("/// @details First.\n///\n/// @par Title\n/// Text.", {"detail": ["First.", "Title Text."]}),
    ("", {}),
    ("///\n///", {}),
    ("/// @return", {}),
]
